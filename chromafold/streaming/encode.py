"""Stateless encoding of a stream of sparse text lines.

A line is encoded inside its row: the dictionary (bounded by the column budget or checked against
``max_entries``) is a constant map, so no aggregation, watermark or state is needed and the plan runs the same on
batches and streams.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.functions.features import canonical_key, feature_name, feature_value, not_blank, number
from chromafold.plans.pipeline import EncoderModel

QUANTIZED = ("sm", "sn", "ss", "ns")


def stream_encoder(model: EncoderModel, max_entries: int = 200_000):
    """A function from a (streaming) DataFrame with a ``value`` column of lines to (target, features).

    For sparse text, with its dense columns, and every kind of encoding; tabular data is encoded in batches.
    """
    kind = model.dictionary.kind
    if "col" in model.vocabulary.columns:
        raise ValueError("only sparse text runs inside a row")
    quantized = kind in QUANTIZED
    names = model.vocabulary.select("key", "fid").join(model.dictionary.table, "fid")
    if kind == "ft":
        entry = F.struct(F.col("fid").alias("idx"), F.lit(0).cast("long").alias("cnt"), F.lit(1.0).alias("val"))
    elif kind == "te":
        entry = F.struct(F.col("color").alias("idx"), F.col("cnt"), F.col("mean").alias("val"))
    elif quantized:  # by color, the largest quantum first; the quantum becomes the index below
        entry = F.struct(F.col("color").alias("idx"), (-F.col("quantum")).cast("long").alias("cnt"), F.col("quantum").cast("double").alias("val"))
    else:
        entry = F.struct(F.col("color").alias("idx"), (-F.col("code")).cast("long").alias("cnt"), F.col("code").cast("double").alias("val"))
    rows = names.select("key", entry.alias("e")).limit(max_entries + 1).collect()
    if len(rows) > max_entries:
        raise ValueError(f"more than {max_entries} features: encode in batches with EncoderModel.transform")
    table = F.from_json(F.lit(_json(rows)), "map<string, struct<idx:int,cnt:bigint,val:double>>")
    pair = "array<struct<idx:int,val:double>>"
    nulls = F.from_json(F.lit(json.dumps([{"idx": r["color"], "val": r["quantum"]} for r in (model.dictionary.table.where("fid < 0").collect() if quantized else [])])), pair)  # one a color at most
    dense_rows = model.vocabulary.where("dense").select("key", "fid").orderBy("fid").collect() if model.ndense else []  # at most 1 / dense_fraction
    dense = [(r["key"], model.dictionary.dense_offset + d) for d, r in enumerate(dense_rows)]

    def encode(lines: DataFrame) -> DataFrame:
        words = F.split(F.rtrim("value"), " ")
        full = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), not_blank)
        keys = F.array_distinct(F.transform(full, lambda w: canonical_key(feature_name(w))))
        hits = F.filter(F.transform(keys, lambda k: F.element_at(table, k)), lambda e: e.isNotNull())
        # the entry that wins its column: smallest count, then smallest absolute value
        ranked = F.transform(hits, lambda e: F.struct(e["idx"].alias("idx"), e["cnt"].alias("cnt"), F.abs(e["val"]).alias("size"), e["val"].alias("val")))
        first = F.filter(F.sort_array(ranked), lambda e: e["val"] != 0) if kind not in ("te", *QUANTIZED) else F.sort_array(ranked)

        def value(key: str) -> Column:
            """The last one on the line."""
            last = F.try_element_at(F.filter(full, lambda w: canonical_key(feature_name(w)) == key), F.lit(-1))
            return F.when(last.isNotNull(), F.coalesce(number(feature_value(last)), F.lit(0.0))).otherwise(0.0)

        values = [value(key) for key, _ in dense]
        columns = F.array(*(F.struct(F.lit(at).alias("idx"), v.alias("val")) for (_, at), v in zip(dense, values, strict=True))).cast(pair)
        out = lines.select(F.get(words, F.lit(0)).try_cast("double").alias("target"), first.alias("s"), columns.alias("dense")).where("target is not null")
        alone = F.filter("s", lambda e, i: (i == 0) | (F.get("s", i - 1)["idx"] != e["idx"]))
        if quantized:
            missing = F.filter(nulls, lambda x: ~F.exists(alone, lambda e: e["idx"] == x["idx"]))
            found = F.concat(F.transform(alone, lambda e: e["val"]), F.transform(missing, lambda e: e["val"]))
            sparse = F.transform(found, lambda q: F.struct(q.cast("int").alias("idx"), F.lit(1.0).alias("val")))
        else:
            sparse = F.transform(F.filter(alone, lambda e: e["val"] != 0), lambda e: F.struct(e["idx"].alias("idx"), e["val"].alias("val")))
        return out.select("target", F.sort_array(F.concat(sparse, F.filter("dense", lambda e: e["val"] != 0))).alias("features"))

    return encode


def _json(rows) -> str:
    return json.dumps({r["key"]: {"idx": r["e"]["idx"], "cnt": r["e"]["cnt"], "val": r["e"]["val"]} for r in rows})
