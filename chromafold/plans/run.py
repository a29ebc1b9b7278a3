"""From training and validation files to encoded files and reports in one call, and grids of such encodings."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.operators import diagnostics, graph, vocab
from chromafold.plans.pipeline import Encoder
from chromafold.sources import readers, writers
from chromafold.sources.lineage import hold
from chromafold.sources.readers import Examples


def compress(spark: SparkSession, train: str, valid: str, kind: str, budget: int, tabular: bool = False, max_k: int = 10, **options) -> dict[str, str]:
    """Learn from ``train``, encode both files beside themselves, and write what was learnt about them.

    Returns the paths of the encoded files (train, valid), the field dimensions (dims) and, for text, the graph of
    the training lines (graph, degrees) and the report of edges that only ``valid`` has (report).
    """
    read = readers.read_tsv if tabular else readers.read_svm
    data, fresh = read(spark, train), read(spark, valid)
    model = Encoder(kind, budget, **options).fit(data, tabular=tabular)
    root = os.path.splitext(train)[0]
    paths = {"train": writers.output_path(train, writers.suffix(kind, budget)), "valid": writers.output_path(valid, writers.suffix(kind, budget)), "dims": f"{root}.{kind}{budget}.field_dims.txt"}
    writers.write_svm(model.transform(data, train=True), paths["train"])
    writers.write_svm(model.transform(fresh), paths["valid"])
    writers.write_field_dims(model.field_dims(), paths["dims"])
    if not tabular:
        seen = hold(graph.edge_counts(vocab.line_arrays(data, model.vocabulary)))
        other = graph.edge_counts(vocab.line_arrays(fresh, model.vocabulary))
        vertices = model.vocabulary.where("not dense").select("fid")
        paths |= {"graph": f"{root}.graph.txt", "degrees": f"{root}.graph.degree.txt", "report": f"{root}.new_edges.json"}
        writers.write_graph(seen, graph.degrees(seen, vertices), paths["graph"])
        report = diagnostics.new_edges(seen, other, fresh.lines.count(), max_k).join(diagnostics.good_turing(seen, data.lines.count(), max_k), "k")
        report.write.mode("overwrite").json(paths["report"])
    return paths


def encoding_grid(data: Examples, kinds: list[str], budgets: list[int], tabular: bool = False, **options) -> DataFrame:
    """(kind, budget, width, entries) of every encoding: its columns and the entries of all encoded lines."""
    out = None
    for kind in kinds:
        for budget in budgets:
            model = Encoder(kind, budget, **options).fit(data, tabular=tabular)
            width = F.broadcast(model.field_dims().agg(F.count("*").alias("width")))  # one row
            row = model.transform(data).agg(F.sum(F.size("features")).alias("entries")).join(width).select(F.lit(kind).alias("kind"), F.lit(budget).alias("budget"), "width", "entries")
            out = row if out is None else out.unionAll(row)
    return out


def summary(data: Examples, vocabulary: DataFrame, edges: DataFrame, colors: DataFrame) -> DataFrame:
    """One row about a data set: its size, its lines, its graph and its coloring."""
    sparse = vocabulary.where("not dense").select("fid")
    size = vocab.cardinality(data)
    lines = vocab.line_stats(vocab.line_arrays(data, vocabulary)).select("max_nnz", "avg_nnz")
    degrees = graph.degree_summary(edges, sparse).select("max_degree")
    colored = colors.agg(F.countDistinct("color").alias("ncolors"))
    return size.join(F.broadcast(lines)).join(F.broadcast(degrees)).join(F.broadcast(colored))  # one row each
