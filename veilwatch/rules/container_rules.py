"""Fixed values of the container checks: lists, order and message texts."""

from __future__ import annotations

# Host ports of well-known data services.
SERVICE_PORTS = [
    (5432, "PostgreSQL"),
    (5433, "PgBouncer"),
    (3306, "MySQL/MariaDB"),
    (3307, "MySQL/MariaDB"),
    (1433, "MSSQL"),
    (1521, "Oracle DB"),
    (6379, "Redis"),
    (27017, "MongoDB"),
    (27018, "MongoDB"),
    (27019, "MongoDB"),
    (9200, "Elasticsearch"),
    (9300, "Elasticsearch"),
    (5984, "CouchDB"),
    (5672, "RabbitMQ"),
    (15672, "RabbitMQ management"),
    (9092, "Kafka"),
    (2181, "ZooKeeper"),
]

# Host path prefixes, first match wins.
DANGEROUS_PREFIXES = [
    ("/:/", "root filesystem"),
    ("/etc/", "/etc — system config"),
    ("/proc/", "/proc"),
    ("/sys/", "/sys"),
    ("/dev/", "/dev"),
    ("/boot/", "/boot"),
    ("/var/run/docker.sock", "Docker socket"),
    ("/run/docker.sock", "Docker socket"),
]

# Fixed values.
DANGEROUS_CAPABILITIES = [
    "ALL", "SYS_ADMIN", "NET_ADMIN", "SYS_PTRACE", "SYS_MODULE", "SYS_RAWIO", "SYS_BOOT", "SYS_TIME",
]
RAW_DEVICE_PREFIXES = ["/dev/sd", "/dev/nvme", "/dev/vd"]
RAW_DEVICES = ["/dev/mem", "/dev/kmem"]
DAEMON_SOCKET = "docker.sock"

# Issue texts; <v> is the flag value, <p> the port, <s> the service or label.
ISSUE = {
    "privileged": "--privileged: full host access — bypasses all container isolation",
    "capability": "--cap-add=<v>: grants dangerous Linux capability",
    "pid": "--pid=host: container sees all host processes via shared PID namespace",
    "ipc": "--ipc=host: container shares host IPC namespace",
    "seccomp": "--security-opt=<v>: disables seccomp syscall filter",
    "apparmor": "--security-opt=<v>: disables AppArmor MAC profile",
    "device": "--device=<v>: mounts a raw storage/memory device into the container",
    "socket": "Docker socket (docker.sock) mounted — container gains full control over the Docker daemon",
    "mount": "dangerous host path '<v>' (<s>) mounted into container",
    "port": "DB port <p> (<s>) published on 0.0.0.0 — exposed on all network interfaces. "
            "Use -p 127.0.0.1:<p>:<p> to restrict to localhost",
    "network": "--network=host: container shares the host network stack — "
               "all ports bind directly on host interfaces",
}

# Texts of the other container operations.
OPERATION = {
    "prune_all_volumes": "docker system prune: would permanently delete "
                         "all unused images, stopped containers, networks, AND volumes",
    "prune_all": "docker system prune: would permanently delete "
                 "all unused images and stopped containers",
    "prune_volumes": "docker system prune: would permanently delete "
                     "stopped containers, networks, and named volumes",
    "prune": "docker system prune: removes stopped containers, dangling images, and unused networks",
    "swarm_init": "docker swarm init: initializes a new Swarm cluster on this node",
    "swarm_join": "docker swarm join: adds this node to an existing Swarm cluster",
    "swarm_leave_force": "docker swarm leave --force: forcibly removes a manager node — "
                         "can destroy the entire cluster",
    "swarm_leave": "docker swarm leave: removes this node from the Swarm cluster",
}
