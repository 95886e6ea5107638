"""How far the sources of a language differ in their words: DuckDB aggregates shards, Spark merges.

1. Every task counts the terms of the texts it reads in DuckDB: occurrences and documents by
   (lang, source, term). These counts are dealt into shards by lang and term.
2. Each shard adds them up in DuckDB and keeps the terms that enough documents of the lang
   hold. What is left is written to the shared folder; sums over it give N and V.
3. The kept counts are dealt into shards again, each with the totals of all groups. A
   shard computes, in DuckDB and in 128-bit integers, its part of every pair's sum and its
   best terms of every group. Spark adds the parts and ranks.

A pair's sum runs over the terms that either source has; for the others the distance is one
constant. So a shard joins the terms that occur, not terms by sources by sources. A term that
many documents hold is one row a task and source before it is dealt, and one row a source after.

Defined results
---------------
* null text, lang and source count as ''. Rows that repeat are documents of their own.
* a group without terms, or in a lang without kept terms, still has its pairs; with V = 0
  their value is 0.
* a lang with one source has no pairs. An empty table gives no rows; extra columns are ignored.
* terms and sources are ranked by value, equal ones by their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectext
from .common import Scratch

#: Documents of a lang that hold a kept term, at least; ranks of part term; what is added to each count; scale of p.
LEAST, TOP, ADDED, SCALE = 30, 50, 5, 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that a task counts at once; rows of counts above which it adds them up, and sends them where that leaves more than half.
PIECE, HELD = 8 << 20, 1_000_000
#: Kept counts of a shard, in the mean; there are at most as many shards as shuffles have partitions.
SHARD = 10_000
#: Memory of DuckDB in a task; it has no folder to spill to.
MEMORY = "400MB"

COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int32())])
FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("shared", pa.int64()), ("n_shared", pa.int64())])

#: Bytes of terms with A-Z in lower case, all others as spaces; bytes of other alphabets belong to terms.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_COUNT = """
with words as (select g, row, unnest(string_split(text, ' ')) as term from docs join groups using (lang, source)),
held as (select row, any_value(g) as g, term, count(*) as n from words where term <> '' group by row, term),
terms as (select g, term, sum(n)::bigint as n, count(*) as docs from held group by g, term)
select lang, source, term, n, docs from terms join groups using (g)"""
_ADD = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from counts group by all"
_P = f"(1 + {SCALE}::hugeint * (n + {ADDED}) // (total + {ADDED}::hugeint * kept))::bigint"


def _duck() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


def _batches(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_table().cast(schema).to_batches(max_chunksize=50_000)


def _types(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'string': 'varchar', 'int32': 'int', 'int64': 'bigint'})[str(f.type)]}" for f in schema)


def _spark_types(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'string': 'string', 'int32': 'int', 'int64': 'long'})[str(f.type)]}" for f in schema)


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows in tables of about `size` bytes of text, one row at least."""
    parts, held = [], 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
        begin = 0
        for end in range(1, len(batch) + 1):
            held += int(lengths[end - 1])
            if held >= size:
                yield pa.Table.from_batches([*parts, batch.slice(begin, end - begin)])
                parts, held, begin = [], 0, end
        if begin < len(batch):
            parts.append(batch.slice(begin))
    if parts:
        yield pa.Table.from_batches(parts)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    """Texts as their terms, parted by spaces."""
    data, offs = vectext.utf8(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offs), pa.py_buffer(_PLAIN[data]))


class _Counts:
    """Counts in a DuckDB table that is added up when it has grown."""

    def __init__(self):
        self.con = _duck()
        self.con.execute(f"create table counts ({_types(COUNTED)})")
        self.rows = 0

    def insert(self, sql: str) -> None:
        self.rows += self.con.execute(f"insert into counts {sql}").fetchall()[0][0]
        if self.rows > HELD:
            self.con.execute(f"create table added as {_ADD}")
            self.con.execute("drop table counts")
            self.con.execute("alter table added rename to counts")
            self.rows = self.con.execute("select count(*) from counts").fetchall()[0][0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for docs in _pieces(batches, PIECE):
        counts.con.register("docs", pa.table({"lang": docs["lang"], "source": docs["source"], "text": _plain(docs["text"]), "row": np.arange(len(docs))}))
        counts.con.execute("create or replace temp table groups as select lang, source, row_number() over () as g from (select distinct lang, source from docs)")
        counts.insert(_COUNT)
        counts.con.unregister("docs")
        if counts.rows > HELD // 2:
            yield from _batches(counts.con, _ADD, COUNTED)
            counts.con.execute("delete from counts")
            counts.rows = 0
    yield from _batches(counts.con, _ADD, COUNTED)
    counts.con.close()


def _keep(least: int):
    sql = f"""
    with one as ({_ADD}), known as (select lang, term from one group by all having sum(docs) >= {least})
    select lang, source, term, n, (row_number() over (partition by lang, term order by source) = 1)::int as first from one semi join known using (lang, term)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts()
        for batch in batches:
            counts.con.register("more", pa.Table.from_batches([batch]))
            counts.insert("select * from more")
            counts.con.unregister("more")
        yield from _batches(counts.con, sql, KEPT)
        counts.con.close()

    return run


def _compare(top: int):
    """A shard's part of the sums of all pairs, and its best terms of every group.

    Rows with a null term are the groups' totals, which come once a shard; a task may hold several shards.
    """
    shared = f"""
    with groups as (select distinct lang, source, total, kept, lang_total, 0 as n from rows where term is null),
    facts as (select lang, source, term, n from rows where term is not null),
    group_p as (select *, {_P} as p0 from groups where kept > 0),
    fact_p as (select f.lang, f.source, f.term, {_P.replace('(n +', '(f.n +')} as p from facts f join group_p g using (lang, source)),
    whole as (select lang, term, sum(n) as n from facts group by all),
    lang_q as (select w.lang, w.term, {_P.replace('(n +', '(w.n +')} as q from whole w join (select distinct lang, lang_total as total, kept from groups) using (lang)),
    """
    sql = f"""{shared}
    best as (
      select lang, source, term, p - q as value from fact_p join lang_q using (lang, term) where p > q
      qualify row_number() over (partition by lang, source order by p - q desc, term) <= {top}),
    pairs as (
      select x.lang, x.source as a, g.source as b, sum(abs(x.p - coalesce(y.p, g.p0))) as value,
        sum(case when x.source < g.source and y.p is not null then abs(x.p - y.p) else 0 end) as shared,
        count(case when x.source < g.source then y.p end) as n_shared
      from fact_p x join group_p g on g.lang = x.lang and g.source <> x.source
      left join fact_p y on y.lang = x.lang and y.term = x.term and y.source = g.source
      group by all)
    select 'term' as part, lang, source, term as item, value::bigint as value, 0::bigint as shared, 0::bigint as n_shared from best
    union all
    select 'pair', lang, least(a, b), greatest(a, b), sum(value)::bigint, sum(shared)::bigint, sum(n_shared)::bigint from pairs group by lang, least(a, b), greatest(a, b)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.execute("create table rows (lang varchar, source varchar, term varchar, n bigint, total bigint, kept bigint, lang_total bigint)")
        for batch in batches:
            con.register("more", pa.Table.from_batches([batch]))
            con.execute("insert into rows select * from more")
            con.unregister("more")
        yield from _batches(con, sql, FOUND)
        con.close()

    return run


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per lang, source and part (pair, term) the ranked items: lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = docs.select(blank(lang), blank(source), blank(text)).toDF("lang", "source", "text")

    counted = plain.mapInArrow(_count, _spark_types(COUNTED)).repartition(n_parts, "lang", "term")
    kept = scratch.save(counted.mapInArrow(_keep(least), _spark_types(KEPT)), "kept")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = kept.groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("lang_total"), F.sum("first").cast("long").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, F.col("lang") == F.col("_lang"), "left")
    groups = scratch.save(groups.select("lang", "source", *(zero(c) for c in ("total", "held", "kept", "lang_total"))), "groups")

    shards = max(1, min(n_parts, -(-kept.count() // SHARD)))
    shard_of = F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    facts = kept.select(shard_of.alias("shard"), "lang", "source", "term", "n", *(none("long").alias(c) for c in ("total", "kept", "lang_total")))
    totals = groups.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lang", "source", none("string").alias("term"), none("long").alias("n"), "total", "kept", "lang_total")
    dealt = facts.unionByName(totals).repartitionById(shards, "shard").drop("shard")
    found = scratch.save(dealt.mapInArrow(_compare(top), _spark_types(FOUND)), "found")

    pairs = found.where("part = 'pair'").groupBy("lang", F.col("source").alias("lo"), F.col("item").alias("hi")).agg(*(F.sum(c).alias(c) for c in ("value", "shared", "n_shared")))
    side = lambda x: groups.select("lang", F.col("source").alias(x), F.col("held").alias(f"held_{x}"), "kept", F.when(F.col("kept") > 0, 1 + F.expr(f"({SCALE * ADDED}L) div (total + {ADDED} * kept)")).alias(f"p0_{x}"))
    # every pair of a lang is part of the result
    both = side("a").join(side("b").drop("kept"), "lang").where("a <> b").withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(pairs, ["lang", "lo", "hi"], "left")
    had = lambda c: F.coalesce(F.col(c), F.lit(0))
    rest = (F.col("kept") - F.col("held_a") - F.col("held_b") + had("n_shared")) * F.abs(F.col("p0_a") - F.col("p0_b"))
    value = F.when(F.col("kept") > 0, had("value") - had("shared") + rest).otherwise(0).cast("long")
    columns = ("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda part, rows: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank)
    # the limit on ranks stands alone above its window, so that tasks drop what can't be among the first
    terms = ranked("term", found.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked("pair", both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))).unionByName(terms)


def sql(least: int = LEAST, top: int = TOP) -> str:
    """The same rows as one DuckDB statement over the view documents: every kept term with every source."""
    p = f"(1 + {SCALE}::hugeint * (c + {ADDED}) // (total + {ADDED}::hugeint * v))::bigint"
    return f"""
    with docs as materialized (select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    words as (select row, lang, source, unnest(regexp_extract_all(text, '{TERM}')) as w from docs),
    held as materialized (select row, lang, source, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term, count(*) as n from words group by all),
    known as materialized (select lang, term from held group by all having count(*) >= {least}),
    groups as materialized (select distinct lang, source from docs),
    counts as (select lang, source, term, sum(n) as n from held group by all),
    grid as (select g.lang, g.source, k.term, coalesce(c.n, 0) as c from groups g join known k using (lang) left join counts c using (lang, source, term)),
    sized as (select *, sum(c) over (partition by lang, source) as total, count(*) over (partition by lang, source) as v from grid),
    ps as materialized (select lang, source, term, c, {p} as p from sized),
    whole as (select lang, term, sum(c) as c from grid group by all),
    whole_sized as (select *, sum(c) over (partition by lang) as total, count(*) over (partition by lang) as v from whole),
    qs as (select lang, term, {p} as q from whole_sized),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
      left join (select x.lang, x.source as a, y.source as b, sum(abs(x.p - y.p)) as value from ps x join ps y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
        on s.lang = a.lang and s.a = a.source and s.b = b.source),
    terms as (select lang, source, 'term' as part, term as item, p - q as value from ps join qs using (lang, term) where c > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
    select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {top}"""
