"""From raw examples to encoded rows: an estimator that learns vocabulary, colors and dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.functions.features import estimation_half, number
from chromafold.operators import coloring, encoders, graph, quantizer, vocab
from chromafold.sources.lineage import hold
from chromafold.sources.readers import Examples

KINDS = ("te", "sm", "sn", "ss", "ns", "ft", "faft", "id")


@dataclass(frozen=True)
class EncoderModel:
    """What ``Encoder.fit`` learnt; ``transform`` works on any examples of the same kind."""

    vocabulary: DataFrame
    colors: DataFrame | None
    dictionary: encoders.Dictionary
    held_for_estimation: DataFrame | None
    ndense: int
    dense_columns: tuple[str, ...] = ()

    def transform(self, data: Examples, train: bool = False) -> DataFrame:
        """(ex_id, target, features). ``train`` leaves out the lines that a split kept for estimation."""
        lines = data.lines
        if train and self.held_for_estimation is not None:
            lines = lines.join(self.held_for_estimation, "ex_id", "left_anti")
        features = vocab.line_features(data, self.vocabulary)
        dense = None
        if self.dense_columns:
            place = F.array_position(F.array(*map(F.lit, self.dense_columns)), F.col("col")).cast("int") - 1
            dense = data.tokens.where(F.col("col").isin(*self.dense_columns)).select("ex_id", place.alias("d"), F.coalesce(number(F.col("value"), True), F.lit(0.0)).alias("val"))
        elif self.ndense:
            nsparse = self.vocabulary.where("not dense").agg(F.count("*").alias("_n"))
            dense = vocab.dense_values(data, self.vocabulary).join(F.broadcast(nsparse)).select("ex_id", (F.col("fid") - F.col("_n")).alias("d"), "val")
        return encoders.encode(features, lines, self.dictionary, dense)

    def field_dims(self) -> DataFrame:
        return encoders.field_dims(self.dictionary, self.ndense)


class Encoder:
    """Learns to encode examples into at most ``budget`` columns.

    ``kind``: te (mean target), ft (frequent features), faft (the same inside colors), id (all inside colors),
    sm and ss (mutual information, estimated on a content-hashed part of the lines), sn and ns (on all lines).
    Tabular data (tokens with a column) is colored by column, other data by its co-occurrence graph; its
    ``dense_columns`` are numbers (empty: zero) that pass through as the last columns, in the order given.
    """

    def __init__(self, kind: str, budget: int, dense_fraction: float = 0.1, freq_cutoff: int = 0, split_rate: int = 1, split: Column | None = None,
                 budget_slack: int = 0, driver_edges: int = coloring.DRIVER_EDGES, dense_columns: tuple[str, ...] | list[str] = ()):
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}")
        self.kind, self.budget, self.dense_fraction, self.freq_cutoff = kind, budget, dense_fraction, freq_cutoff
        self.split_rate, self.split, self.budget_slack, self.driver_edges = split_rate, split, budget_slack, driver_edges
        self.dense_columns = tuple(dense_columns)

    def _estimation(self, data: Examples) -> DataFrame:
        """Ids of the lines that only estimate."""
        if self.split is not None:
            return data.lines.where(self.split).select("ex_id")
        words = data.tokens.groupBy("ex_id").agg(F.sort_array(F.collect_list(F.struct("pos", "col", "key", "value"))).alias("w"))
        text = F.concat(F.array(F.col("target").cast("string")), F.coalesce(F.transform("w", lambda x: F.concat_ws(":", x["col"], x["key"], x["value"])), F.array().cast("array<string>")))
        return data.lines.join(words, "ex_id", "left").where(estimation_half(text, self.split_rate)).select("ex_id")

    def fit(self, data: Examples, tabular: bool = False) -> EncoderModel:
        if self.dense_columns and not tabular:
            raise ValueError("only tabular data has columns that can be dense")
        data = Examples(data.lines, data.tokens.where(~F.col("col").isin(*self.dense_columns))) if self.dense_columns else data
        found = vocab.fit_table_vocab(data) if tabular else vocab.fit_vocab(data, self.dense_fraction, self.freq_cutoff)
        found = hold(found)
        ndense = len(self.dense_columns) if tabular else found.where("dense").count()
        colors = None
        if tabular:
            colors = hold(coloring.table_colors(found).select("fid", "color"))
        elif self.kind != "ft":
            sparse = found.where("not dense")
            colors = hold(coloring.color(graph.edge_counts(vocab.line_arrays(data, found)), sparse.select("fid"), self.driver_edges))
        sparse = found if tabular else found.where("not dense")
        features, lines, held = vocab.line_features(data, found), data.lines, None
        if self.kind == "ft":
            dictionary = encoders.fit_frequency(sparse, self.budget, ndense)
        elif self.kind == "te":
            dictionary = encoders.fit_target(features, lines, colors, self.budget, ndense)
        elif self.kind == "faft":
            dictionary = encoders.fit_field_aware(sparse, colors, self.budget, ndense)
        elif self.kind == "id":
            dictionary = encoders.fit_identity(colors, self.budget, ndense)
        else:
            if self.kind in ("sm", "ss"):
                held = hold(self._estimation(data))
                lines = lines.join(held, "ex_id", "left_semi")
            dictionary = quantizer.fit_quantizer(features, lines, colors, self.budget, ndense, self.kind, self.budget_slack)
        return EncoderModel(found, colors, dictionary, held, ndense, self.dense_columns)
