"""Command line expressions over an ``array<string>`` of tokens.

``argv`` is a column name or a Spark SQL expression.  Every function returns a column expression
written as one SQL text; nothing here leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwatch.functions.text import sql_literal, sql_strings
from veilwatch.rules.kv_rules import VALUE_FLAGS
from veilwatch.rules.sql_rules import SQL_TOOLS, SqlTool

SOURCE_TYPE = "struct<kind:string,value:string>"
_NO_SOURCE = f"cast(null as {SOURCE_TYPE})"


def split_argv(raw: str) -> Column:
    """Tokens of a NUL-separated command line; empty tokens are dropped."""
    text = F.make_valid_utf8(F.col(raw).cast("string"))
    return F.filter(F.split(text, "\u0000"), lambda x: x != "")


def with_argv(df: DataFrame, raw: str = "cmdline", out: str = "argv") -> DataFrame:
    """Add ``argv`` and drop rows whose command line is missing or empty."""
    return df.withColumn(out, split_argv(raw)).filter(F.size(out) > 0)


def _rest(argv: str) -> str:
    return f"slice({argv}, 2, greatest(size({argv}), 1))"


def _positionals(argv: str) -> str:
    return f"filter({_rest(argv)}, x -> not startswith(x, '-'))"


def positionals(argv: str = "argv") -> Column:
    """Tokens after the program name that do not start with a dash."""
    return F.expr(_positionals(argv))


def positional(argv: str, n: int) -> Column:
    """The n-th positional, counted from 1; null when there is none."""
    return F.expr(f"get({_positionals(argv)}, {n - 1})")


def _last_of_two(argv: str) -> str:
    args = _positionals(argv)
    return f"if(size({args}) >= 2, try_element_at({args}, -1), null)"


def kv_positional(argv: str = "argv") -> Column:
    """Positionals of the key-value tool, upper-cased; value flags swallow the next token."""
    flags = ", ".join(sql_literal(f) for f in VALUE_FLAGS)
    return F.expr(f"""aggregate({_rest(argv)},
        named_struct('skip', false, 'out', cast(array() as array<string>)),
        (acc, x) -> named_struct(
            'skip', not acc.skip and x in ({flags}),
            'out', if(acc.skip or startswith(x, '-'), acc.out, concat(acc.out, array(upper(x))))),
        acc -> acc.out)""")


def _after(argv: str, token: str) -> str:
    return (f"if(array_contains({argv}, '{token}'), slice({argv}, "
            f"cast(array_position({argv}, '{token}') as int) + 1, greatest(size({argv}), 1)), null)")


def pod_name(argv: str = "argv") -> Column:
    """First token after an ``exec`` that is neither a flag nor ``exec`` itself."""
    rest = _after(_rest(argv), "exec")
    return F.expr(f"""coalesce(get(filter({rest}, x -> not startswith(x, '-') and x <> 'exec'), 0),
                               '<unknown-pod>')""")


def after_separator(argv: str = "argv") -> Column:
    """The sub-command after the first ``--``; null without a separator."""
    return F.expr(_after(argv, "--"))


def has_flag(argv: str, flag: str) -> Column:
    return F.expr(f"exists({argv}, x -> x = '{flag}' or startswith(x, '{flag}='))")


def _collect(argv: str, flags: list[str], attached: str) -> Column:
    """Tokens that follow one of the flags, and what ``attached`` finds in other tokens."""
    names = ", ".join(sql_literal(f) for f in flags)
    return F.expr(f"""aggregate({argv},
        named_struct('pending', false, 'out', cast(array() as array<string>)),
        (acc, x) -> named_struct(
            'pending', not acc.pending and x in ({names}),
            'out', case when acc.pending then concat(acc.out, array(x))
                        when x in ({names}) or ({attached}) is null then acc.out
                        else concat(acc.out, array({attached})) end),
        acc -> acc.out)""")


def flag_values(argv: str, flag: str) -> Column:
    """Values given as ``--flag v`` or ``--flag=v``; a value may equal the flag."""
    return _collect(argv, [flag], f"if(startswith(x, '{flag}='), substring(x, {len(flag) + 2}), null)")


def collect_specs(argv: str, flags: list[str]) -> Column:
    """Values of any of the flags, also attached to a one-letter flag (``-p80:80``)."""
    cases = ""
    for flag in flags:
        cases += f" when startswith(x, '{flag}=') then substring(x, {len(flag) + 2})"
        if len(flag) == 2:
            cases += f" when startswith(x, '{flag}') then substring(x, 3)"
    return _collect(argv, flags, f"case{cases} end")


def _first_flag(argv: str, flags: list[str]) -> str:
    """``struct<value>`` of the first token that is one of the flags or ``flag=v``; null without
    such a token.  A flag that ends the command line has a null value."""
    names = ", ".join(sql_literal(f) for f in flags)
    cases = f"when x in ({names}) then named_struct('value', get({argv}, i + 1))"
    for flag in flags:
        cases += f" when startswith(x, '{flag}=') then named_struct('value', substring(x, {len(flag) + 2}))"
    return f"get(filter(transform({argv}, (x, i) -> case {cases} end), h -> h is not null), 0)"


def _source(kind: str, value: str) -> str:
    return f"if(({value}) is not null, named_struct('kind', '{kind}', 'value', {value}), null)"


def _audit_source(argv: str, tool: SqlTool) -> str:
    found = []
    if tool.sql_flags:
        found.append(_source("inline", _first_flag(argv, tool.sql_flags) + ".value"))
    if tool.file_flags:
        found.append(_source("file", _first_flag(argv, tool.file_flags) + ".value"))
    if tool.positional:
        found.append(_source("inline", _last_of_two(argv)))
    return f"coalesce({', '.join(found)}, {_NO_SOURCE})"


def _policy_source(argv: str, tool: SqlTool) -> str:
    cases = f"when false then {_NO_SOURCE}"
    for flag in tool.sql_flags:
        hit = _first_flag(argv, [flag])
        cases += f" when {hit} is not null then {_source('inline', hit + '.value')}"
    for flag in tool.file_flags:
        at = f"cast(array_position({argv}, '{flag}') as int)"
        cases += f" when {at} between 1 and size({argv}) - 1 then {_source('file', f'get({argv}, {at})')}"
    if tool.positional:
        cases += f" else {_source('inline', _last_of_two(argv))}"
    return f"case {cases} end"


def extract_sql(argv: str, tool: str, order: str) -> Column:
    """Where a SQL tool's command line holds its SQL: ``struct<kind, value>``, or null.

    ``kind`` is ``inline`` or ``file`` (then ``value`` is the path); ``tool`` is a column or SQL
    expression.  ``order='audit'`` looks token by token for any SQL flag, then for any file flag.
    ``order='policy'`` looks flag by flag, stops with null at a SQL flag without a value, and knows
    files only as ``flag path``.
    """
    build = {"audit": _audit_source, "policy": _policy_source}[order]
    cases = " ".join(f"when '{name}' then {build(argv, spec)}" for name, spec in SQL_TOOLS.items())
    return F.expr(f"case {tool} {cases} end")


def names_file(argv: str = "argv") -> Column:
    """Cheap test whether a command line may name a SQL file: true for all that do."""
    flags = sorted({f for tool in SQL_TOOLS.values() for f in tool.file_flags})
    attached = " or ".join(f"startswith(x, '{f}=')" for f in flags)
    return F.expr(f"exists({argv}, x -> array_contains({sql_strings(flags)}, x) or {attached})")
