"""Registry of named queries over the driver tables, each with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefengine.sources.readers import driver_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a (spark, sf_dir) -> DataFrame query and, when SQL-expressible, its oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return driver_table(spark, sf_dir, name)


# ---------------------------------------------------------------- SQL oracle helpers
# DuckDB spellings of the Spark column functions used by the queries.

def sql_tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '\\s+'), lambda x: x <> '')"


def sql_md5_bits(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


def sql_text_score(text: str) -> str:
    return (f"((length({text}) % 13)::DOUBLE / 4.0 + ({sql_md5_bits(text)} % 4)::DOUBLE / 2.0)")


def sql_fixed_mean(expr: str, scale: int = 2) -> str:
    """Exact decimal sum, one division: the same double as functions.math.fixed_point_mean."""
    return f"(sum(({expr})::DECIMAL(38, {scale}))::DOUBLE / count({expr})::DOUBLE)"


def sql_softplus(z: str) -> str:
    return f"(ln(1.0 + exp(-abs({z}))) + greatest({z}, 0.0))"


def sql_r(expr: str, digits: int = 6) -> str:
    """Rounded double; + 0.0 turns -0.0 into 0.0 as Spark prints it."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0)"


def sql_ngram_model(name: str, corpus_sql: str, n: int = 2) -> str:
    """CTEs {name}_g (ctx, tok, c_ngram), {name}_c (ctx, c_ctx), {name}_v (v) for a corpus
    query that yields a ``text`` column."""
    return f"""
{name}_t AS (SELECT {sql_tokens('text')} AS t FROM ({corpus_sql})),
{name}_x AS (SELECT t, unnest(range(1, len(t) + 1)) AS pos FROM {name}_t),
{name}_g AS (SELECT {sql_ctx('t', 'pos', n)} AS ctx, t[pos] AS tok, count(*) AS c_ngram
             FROM {name}_x GROUP BY ALL),
{name}_c AS (SELECT ctx, sum(c_ngram) AS c_ctx FROM {name}_g GROUP BY ctx),
{name}_v AS (SELECT count(DISTINCT tok) AS v FROM {name}_g)"""


def sql_ctx(t: str, pos: str, n: int) -> str:
    if n == 1:
        return "''"
    padded = f"list_concat([{', '.join(['\'<s>\''] * (n - 1))}], {t})"
    return f"array_to_string({padded}[{pos}:{pos} + {n - 2}], ' ')"


def sql_ngram_score(name: str, model: str, rows_sql: str, key: list[str], n: int = 2, k: float = 1.0,
                    out: str = "logp", length: str | None = None) -> str:
    """CTE {name} (key..., out[, length]) scoring ``rows_sql`` (key..., text) with model CTEs."""
    ks = ", ".join(key)
    extra = f", coalesce(sum(m), 0)::BIGINT AS {length}" if length else ""
    return f"""
{name}_r AS (SELECT {ks}, {sql_tokens('text')} AS t FROM ({rows_sql})),
{name}_x AS (SELECT {ks}, t, unnest(range(1, len(t) + 1)) AS pos FROM {name}_r),
{name}_m AS (SELECT {ks}, {sql_ctx('t', 'pos', n)} AS ctx, t[pos] AS tok, count(*) AS m
             FROM {name}_x GROUP BY ALL),
{name}_s AS (SELECT {ks}, m, m * ln((coalesce(g.c_ngram, 0) + {k}) / (coalesce(c.c_ctx, 0) + {k} * (SELECT v FROM {model}_v))) AS lp
             FROM {name}_m LEFT JOIN {model}_g g USING (ctx, tok) LEFT JOIN {model}_c c USING (ctx)),
{name} AS (SELECT {', '.join('r.' + c for c in key)}, coalesce(sum(lp), 0.0) AS {out}{extra}
           FROM (SELECT DISTINCT {ks} FROM {name}_r) r LEFT JOIN {name}_s s USING ({ks}) GROUP BY ALL)"""
