"""Concept mentions, relations, attempts and segments derived from the test tables.

The texts run unchanged in Spark and in DuckDB; with_views() puts the ones a
query needs before it, so both engines start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

KIND = "case concat(l.l_returnflag, l.l_linestatus) when 'RO' then 'prereq_of' when 'RF' then 'is_a' when 'AO' then 'part-of' when 'AF' then 'contrasts_with' when 'NO' then 'sibling' else '' end"
EXAMPLE = """concat('Worked case ', cast(l.l_linenumber as string), ' of ', trim(m.title)) as text, m.title as concept,
case l.l_returnflag when 'A' then 'code' when 'R' then 'math' end as example_type"""
VIEWS = {
    "v_line": """select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) as rn from lineitem""",
    "v_mention": """select cast(l.l_orderkey as string) as chunk_id, l.rn as pos,
concat('https://', case l.l_suppkey % 4 when 3 then 'www.youtube.com/watch?v=s' else 'host.example.org/s' end, cast(l.l_suppkey as string), case l.l_suppkey % 4 when 0 then '.pdf' when 1 then '.pptx' else '' end) as source_url,
case l.rn % 4 when 0 then concat(upper(substring(p.p_name,1,1)), substring(p.p_name,2), ' ', p.p_brand)
when 1 then upper(concat(p.p_name, ' ', p.p_brand))
when 2 then concat(p.p_name, ' ', p.p_brand, 's')
else concat('  ', p.p_name, '  ', p.p_brand, ' ') end as title,
repeat(concat(p.p_type, ' '), cast(l.l_quantity as int) % 5) as definition,
case when p.p_size <= 15 then 'beginner' when p.p_size <= 30 then 'intermediate' when p.p_size <= 45 then 'advanced' end as difficulty,
concat(p.p_brand, ' ', p.p_name) as alias
from v_line l join part p on l.l_partkey = p.p_partkey""",
    "v_relation": f"""select a.chunk_id, a.pos, a.title as source, b.title as target,
{KIND} as relation_type
from v_mention a join v_mention b on a.chunk_id = b.chunk_id and b.pos = a.pos + 1
join v_line l on cast(l.l_orderkey as string) = a.chunk_id and l.rn = a.pos""",
    "v_example": f"""select m.chunk_id, m.pos, m.source_url, {EXAMPLE}
from v_mention m join v_line l on cast(l.l_orderkey as string) = m.chunk_id and l.rn = m.pos where l.l_quantity > 40""",
    "v_attempt": """select concat('https://host.example.org/u', cast(user_id as string)) as url, ts,
case event_id % 5 when 0 then 404 when 1 then 500 when 2 then 503 end as status_code,
case event_id % 5 when 3 then 'timeout' when 4 then 'request' end as error_kind, props as message, event_id
from events where event_type = 'error'""",
    "v_segment": """select conv_id as video_id, turn as pos, text, cast(10 * turn as double) as start, length(text) / 10.0 as duration from conversations""",
    "v_document": """select doc_id, concat('https://host.example.org/', source, '/', cast(doc_id as string)) as source_url, source as source_type, text from documents""",
}
NEEDS = {"v_mention": ["v_line"], "v_relation": ["v_mention", "v_line"], "v_example": ["v_mention", "v_line"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def with_views(names: str, sql: str) -> str:
    """SQL for DuckDB with the named views (space-separated) before it; sql may begin with further "with" parts."""
    parts = ", ".join(f"{n} as ({VIEWS[n]})" for n in _closure(names.split()))
    body = sql.strip()
    recursive = body.lower().startswith("with recursive")
    if body.lower().startswith("with"):
        body = body[14:] if recursive else body[4:]
        return f"with {'recursive ' if recursive else ''}{parts}, {body}"
    return f"with {parts} {body}"


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view, or a table, as a DataFrame; views in `given` are taken as they are there."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    frames = dict(given or {})
    for n in _closure([name]):
        if n in frames:
            continue
        frames[n] = spark.sql(
            _with_places(VIEWS[n]), **{k: frames[k] if k in frames else spark.read.parquet(f"{sf_dir}/{k}.parquet") for k in _used(VIEWS[n])}
        )
    return frames[name]


def _beside(name: str, columns: list[str]) -> str:
    """A view's text with further columns of its rows l."""
    return VIEWS[name].replace("select ", f"select {', '.join('l.' + c for c in columns)}, ", 1)


def graph_views(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """v_mention, v_relation and v_example with the rows that their texts give, made from one kept table of mentions.

    A mention keeps what its line says and the part of the line after it, so
    that neither relations nor examples join mentions and lines with themselves.
    """
    # the order of v_line, which names every column: lines that tie are alike
    order = VIEWS["v_line"].split("order by ")[1].split(")")[0].split(", ")
    line = view(spark, sf_dir, "v_line").withColumn("next_partkey", F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy(*order)))
    own = "l_linenumber l_quantity l_returnflag l_linestatus next_partkey".split()
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    # only what the view asks for goes through the join
    line = line.select("l_orderkey", "l_partkey", "l_suppkey", "rn", *own)
    wide = keep(spark.sql(_with_places(_beside("v_mention", own)), v_line=line, part=part))
    ends = wide.where("chunk_id is not null and next_partkey is not null").selectExpr(
        "chunk_id as l_orderkey", "pos + 1 as rn", "next_partkey as l_partkey", "0 as l_suppkey", "0 as l_quantity", "title as source", f"{KIND.replace('l.', '')} as relation_type"
    )
    relations = spark.sql(_with_places(_beside("v_mention", ["source", "relation_type"])), v_line=ends, part=part)
    examples = spark.sql(f"select m.chunk_id, m.pos, m.source_url, {EXAMPLE.replace('l.', 'm.')} from {{wide}} m where m.l_quantity > 40 and m.chunk_id is not null", wide=wide)
    return {
        "v_line": line,
        "v_mention": wide.drop(*own),
        "v_relation": relations.selectExpr("chunk_id", "pos - 1 as pos", "source", "title as target", "relation_type"),
        "v_example": examples,
    }


def _used(sql: str) -> list[str]:
    words = set(sql.replace("(", " ").replace(",", " ").split())
    return [n for n in [*TABLES, *VIEWS] if n in words]


def _with_places(sql: str) -> str:
    for n in _used(sql):
        for key in ("from", "join"):
            sql = sql.replace(f"{key} {n} ", f"{key} {{{n}}} ") if f"{key} {n} " in sql else (sql[: -len(n)] + f"{{{n}}}" if sql.endswith(f"{key} {n}") else sql)
    return sql
