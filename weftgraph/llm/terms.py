"""How often every distinct term occurs and in how many records.

1. A dictionary gives every distinct term an integer; it is written once, so the numbers
   stay the same for all later stages.  Within a written partition they are consecutive.
2. Occurrences are encoded and brought to one row per scope, term and record, with the
   number of occurrences.  Copies of a row collapse before the shuffle.
3. Each task sums its rows into count arrays, one pair (occurrences, records) for each
   scope and identifier range; only identifiers that occur are kept in an array.
4. The arrays of one range are added up and read out against the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.durable import durable, kept
from weftgraph.plans.skew import heavy_keys, split_join

#: Identifiers in one range: the unit in which count arrays are sent and added.
RANGE_BITS = 12
#: Cells (scope and identifier) a task holds before it hands its arrays on.
CELLS = 1_000_000

_ARRAYS = "workspace string, field_name string, range long, ids array<long>, occurrences array<long>, records array<long>"


def normal_term(text: Column) -> Column:
    """Trimmed, runs of white space made one space, lower case.  Null stays null."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def json_strings(props: Column, field: str) -> Column:
    """Strings under ``field`` of a JSON object: the strings of a list, or a single string.

    Null or invalid JSON, a missing field and values of other kinds give no strings.
    """
    value = F.try_parse_json(props)
    kind = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
    single = F.when(kind == "STRING", F.array(F.try_variant_get(value, f"$.{field}", "string")))
    many = F.when(kind.startswith("ARRAY"), F.filter(F.try_variant_get(value, f"$.{field}", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"))
    return F.coalesce(single, F.transform(many, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def dictionary(terms: DataFrame) -> DataFrame:
    """``term, term_id`` of the distinct non-empty terms, written once."""
    distinct = terms.select("term").where("term is not null and term <> ''").distinct()
    return durable(distinct.withColumn("term_id", F.monotonically_increasing_id()), "dictionary")


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count arrays of the rows ``workspace, field_name, term_id, n`` of one task."""
    cells: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    held = 0

    def add(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        occ, rec = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(occ, at, np.concatenate([p[1] for p in parts]))
        np.add.at(rec, at, np.concatenate([p[2] for p in parts]))
        return ids, occ, rec

    def flush() -> Iterator[pa.RecordBatch]:
        out = []
        for (scope, field), parts in cells.items():
            ids, occ, rec = add(parts)
            ranges = ids >> RANGE_BITS
            cut = np.flatnonzero(np.diff(ranges)) + 1
            for i, o, r in zip(np.split(ids, cut), np.split(occ, cut), np.split(rec, cut)):
                out.append((scope, field, int(i[0] >> RANGE_BITS), i, o, r))
        cells.clear()
        for k in range(0, len(out), 10_000):
            some = list(zip(*out[k : k + 10_000]))
            kinds = [pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], names=["workspace", "field_name", "range", "ids", "occurrences", "records"])

    for batch in batches:
        scope, field = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        ids, n = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
        names, fields = scope.dictionary.to_pylist(), field.dictionary.to_pylist()
        key = scope.indices.to_numpy().astype(np.int64) * len(fields) + field.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.diff(key[order])) + 1
        for rows in np.split(order, cut):
            if len(rows):
                cell = cells.setdefault((names[key[rows[0]] // len(fields)], fields[key[rows[0]] % len(fields)]), [])
                part = add([(ids[rows], n[rows], np.ones(len(rows), np.int64))])
                cell.append(part)
                held += len(part[0])
                if len(cell) >= 16:
                    before = sum(len(p[0]) for p in cell)
                    cell[:] = [add(cell)]
                    held += len(cell[0][0]) - before
        if held > CELLS:
            yield from flush()
            held = 0
    yield from flush()


def _sum_arrays(key: tuple, table: pa.Table) -> pa.Table:
    """Add up the arrays of one scope, field and identifier range."""
    flat = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "occurrences", "records")]
    ids, at = np.unique(flat[0], return_inverse=True)
    occ, rec = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    np.add.at(occ, at, flat[1])
    np.add.at(rec, at, flat[2])
    n = len(ids)
    return pa.table({"workspace": pa.array([key[0].as_py()] * n, pa.string()), "field_name": pa.array([key[1].as_py()] * n, pa.string()), "term_id": pa.array(ids, pa.int64()), "occurrences": pa.array(occ, pa.int64()), "records": pa.array(rec, pa.int64())})


def count_terms(encoded: DataFrame) -> DataFrame:
    """``workspace, field_name, term_id, occurrences, records`` from rows ``workspace, field_name, term_id, record_id``.

    Rows with a null workspace, term or record are left out.  One row per scope, field
    and term; an empty input gives an empty result.
    """
    per_record = encoded.dropna(subset=["workspace", "field_name", "term_id", "record_id"]).groupBy("workspace", "field_name", "term_id", "record_id").agg(F.count(F.lit(1)).alias("n"))
    arrays = per_record.select("workspace", "field_name", "term_id", "n").mapInArrow(_accumulate, _ARRAYS)
    return arrays.groupBy("workspace", "field_name", "range").applyInArrow(_sum_arrays, "workspace string, field_name string, term_id long, occurrences long, records long")


@kept("terms")
def term_table(mentions: DataFrame, entities: DataFrame, shared: DataFrame) -> DataFrame:
    """Every term of a workspace with its counts, its workspace's number of records, and its mark.

    Columns ``workspace, field_name, term, occurrences, records, total, mark``; mark is
    null for terms neither too rare nor too common.

    * field ``name``: the names of ``entities`` and ``shared``; a record is a chunk that
      mentions an entity of that name in the mention's workspace; ``rare`` has 1 or 2
      records, ``common`` more than 4 % of the workspace's mentioned chunks (and more than 2).
    * field ``tag``: the strings of ``tags`` in the props of ``entities``; a record is an
      entity; ``rare`` has 1, ``common`` more than 1 and more than 10 % of the entities.

    A row delivered twice counts once; mentions of unknown entities have no term;
    null ids, names and workspaces take no part; a term nobody mentions has no row.
    """
    named = entities.select("id", "name").unionByName(shared.select("id", "name")).select("id", normal_term(F.col("name")).alias("term")).where("id is not null and term <> ''").distinct()
    tagged = entities.select("workspace", F.col("id").alias("record_id"), F.posexplode(json_strings(F.col("props"), "tags")).alias("at", "tag")).select("workspace", "record_id", "at", normal_term(F.col("tag")).alias("term")).where("record_id is not null and term <> ''").distinct()
    words = dictionary(named.select("term").unionByName(tagged.select("term")))

    term_ids = named.join(words, "term").groupBy("id").agg(F.collect_list("term_id").alias("term_ids")).withColumnRenamed("id", "entity_id")
    pairs = mentions.select("id", "workspace", "entity_id", "chunk_id").distinct()
    by_name = split_join(pairs, term_ids, ["entity_id"], heavy=heavy_keys(mentions, ["entity_id"])).select("workspace", F.lit("name").alias("field_name"), F.explode("term_ids").alias("term_id"), F.col("chunk_id").alias("record_id"))
    by_tag = tagged.join(words, "term").select("workspace", F.lit("tag").alias("field_name"), "term_id", "record_id")
    counts = count_terms(by_name.unionByName(by_tag))

    chunks = mentions.select("workspace", F.lit("name").alias("field_name"), F.col("chunk_id").alias("r"))
    ids = entities.select("workspace", F.lit("tag").alias("field_name"), F.col("id").alias("r"))
    totals = chunks.unionByName(ids).where("workspace is not null and r is not null").distinct().groupBy("workspace", "field_name").agg(F.count(F.lit(1)).alias("total"))

    n, total = F.col("records"), F.col("total")
    mark = F.when(F.col("field_name") == "name", F.when(n <= 2, "rare").when(n * 100 > total * 4, "common")).otherwise(F.when(n <= 1, "rare").when(n * 10 > total, "common"))
    return counts.join(totals, ["workspace", "field_name"]).join(words, "term_id").select("workspace", "field_name", "term", "occurrences", "records", "total", mark.alias("mark"))
