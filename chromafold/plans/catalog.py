"""Registry of the queries over the standard tables and of their SQL equivalents.

Each query applies one operator to whole tables. Encoded rows are shown as sorted ``index:value`` text and
doubles are rounded to six places, so that both engines can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromafold.functions import features as fx
from chromafold.operators import coloring, diagnostics, encoders, graph, learners, quantizer, reports, vocab
from chromafold.plans import fixtures as fix
from chromafold.plans import run
from chromafold.plans.pipeline import Encoder
from chromafold.sources import readers, writers
from chromafold.sources.lineage import hold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is any."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def shown(encoded: DataFrame, digits: int = 6) -> DataFrame:
    """(ex_id, target, encoded): entries as text with rounded values."""
    text = F.array_join(F.transform("features", lambda e: F.concat(e["idx"].cast("string"), F.lit(":"), F.format_string("%.6f", F.round(e["val"], digits)))), " ")
    return encoded.select("ex_id", "target", text.alias("encoded"))


SHOW = "string_agg(CAST(idx AS VARCHAR) || ':' || printf('%.6f', round(val, 6)), ' ' ORDER BY idx)"


def basket_parts(spark: SparkSession, sf_dir: str):
    data = fix.basket(spark, sf_dir)
    words = vocab.fit_vocab(data, dense_fraction=2)
    return data, words


def basket_edges(spark: SparkSession, sf_dir: str):
    data, words = basket_parts(spark, sf_dir)
    return data, words, graph.edge_counts(vocab.line_arrays(data, words))


def split_edges(spark: SparkSession, sf_dir: str):
    train, valid = fix.basket(spark, sf_dir, "train"), fix.basket(spark, sf_dir, "valid")
    words = vocab.fit_vocab(train, dense_fraction=2)
    return train, valid, words, graph.edge_counts(vocab.line_arrays(train, words)), graph.edge_counts(vocab.line_arrays(valid, words))


def tabular_parts(spark: SparkSession, sf_dir: str):
    data = fix.tabular(spark, sf_dir)
    words = vocab.fit_table_vocab(data)
    return data, words, coloring.table_colors(words).select("fid", "color"), vocab.line_features(data, words)


# Vocabulary


@query(f"WITH {fix.BASKET} SELECT (SELECT count(*) FROM lines) AS nlines, count(*) AS nwords, count(DISTINCT key) AS nfeatures FROM basket")
def word_cardinality(spark, sf_dir):
    return vocab.cardinality(fix.basket(spark, sf_dir))


@query(f"WITH {fix.BASKET} SELECT key, cnt, fid FROM vocab")
def vocab_sparse_index(spark, sf_dir):
    return basket_parts(spark, sf_dir)[1].select("key", "cnt", "fid")


@query(f"WITH {fix.USER_DAYS} SELECT key, cnt, dense, fid FROM vocab")
def vocab_dense_index(spark, sf_dir):
    return vocab.fit_vocab(fix.user_days(spark, sf_dir))


@query(f"WITH {fix.USER_DAYS} SELECT key, cnt, row_number() OVER (ORDER BY cnt DESC, key) - 1 AS fid FROM counts WHERE NOT dense AND cnt >= 100")
def vocab_freq_cutoff(spark, sf_dir):
    return vocab.fit_vocab(fix.user_days(spark, sf_dir), freq_cutoff=100).where("not dense").select("key", "cnt", "fid")


@query(f"WITH {fix.TABULAR} SELECT col, key, cnt, fid FROM vocab")
def vocab_tsv_index(spark, sf_dir):
    return tabular_parts(spark, sf_dir)[1]


@query(r"""
WITH w AS (SELECT DISTINCT CASE l_partkey % 5 WHEN 0 THEN '00' || l_partkey WHEN 1 THEN '+' || l_partkey WHEN 2 THEN '-' || l_partkey
           WHEN 3 THEN l_partkey || '.0' ELSE '1844674407370955' || (1000 + l_partkey % 9000) END AS word FROM lineitem)
SELECT word, CASE WHEN regexp_full_match(word, '\+?[0-9]+') AND TRY_CAST(ltrim(word, '+') AS UBIGINT) IS NOT NULL
       THEN CAST(TRY_CAST(ltrim(word, '+') AS UBIGINT) AS VARCHAR) ELSE word END AS key FROM w""")
def canonical_key(spark, sf_dir):
    k = F.col("l_partkey")
    s = k.cast("string")
    word = (F.when(k % 5 == 0, F.concat(F.lit("00"), s)).when(k % 5 == 1, F.concat(F.lit("+"), s)).when(k % 5 == 2, F.concat(F.lit("-"), s))
            .when(k % 5 == 3, F.concat(s, F.lit(".0"))).otherwise(F.concat(F.lit("1844674407370955"), (1000 + k % 9000).cast("string"))))
    return fix.table(spark, sf_dir, "lineitem").select(word.alias("word")).distinct().select("word", fx.canonical_key(F.col("word")).alias("key"))


@query(r"""
WITH w AS (SELECT DISTINCT event_type || CASE user_id % 4 WHEN 0 THEN '' WHEN 1 THEN ':' WHEN 2 THEN ':b:' || user_id ELSE ':' || user_id END AS word FROM events)
SELECT word, CASE WHEN instr(word, ':') > 0 THEN regexp_extract(word, '^(.*):[^:]*$', 1) ELSE word END AS name,
       CASE WHEN instr(word, ':') > 0 THEN regexp_extract(word, ':([^:]*)$', 1) ELSE '1' END AS val FROM w""")
def pair_value(spark, sf_dir):
    u = F.col("user_id")
    s = u.cast("string")
    tail = F.when(u % 4 == 0, "").when(u % 4 == 1, ":").when(u % 4 == 2, F.concat(F.lit(":b:"), s)).otherwise(F.concat(F.lit(":"), s))
    words = fix.table(spark, sf_dir, "events").select(F.concat("event_type", tail).alias("word")).distinct()
    return words.select("word", fx.feature_name(F.col("word")).alias("name"), fx.feature_value(F.col("word")).alias("val"))


@query(f"""WITH {fix.USER_DAYS}
SELECT t.ex_id, v.fid, round(arg_max(t.value, t.pos), 6) AS val FROM tokens t JOIN vocab v USING (key) WHERE v.dense GROUP BY 1, 2""")
def dense_projection(spark, sf_dir):
    data = fix.user_days(spark, sf_dir)
    return vocab.dense_values(data, vocab.fit_vocab(data)).select("ex_id", "fid", r6("val").alias("val"))


@query(f"""WITH {fix.BASKET}, n AS (SELECT ex_id, count(*) AS n FROM basket GROUP BY ex_id)
SELECT min(n) AS min_nnz, round(quantile_cont(n, 0.5), 6) AS median_nnz, round(avg(n), 6) AS mean_nnz, max(n) AS max_nnz FROM n""")
def line_nnz_stats(spark, sf_dir):
    return vocab.word_stats(fix.basket(spark, sf_dir)).select("min_nnz", r6("median_nnz").alias("median_nnz"), r6("mean_nnz").alias("mean_nnz"), "max_nnz")


@query(f"""WITH {fix.BASKET}, n AS (SELECT ex_id, count(*) AS n FROM features GROUP BY ex_id)
SELECT count(*) AS nlines, max(n) AS max_nnz, CAST(floor(sum(n) / count(*)) AS BIGINT) AS avg_nnz, CAST(floor(sum(n * (n - 1) / 2) / count(*)) AS BIGINT) AS avg_pairs FROM n""")
def graph_line_stats(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    return vocab.line_stats(vocab.line_arrays(data, words))


QUANTILE_SQL = ", ".join(f"({p})" for p in vocab.QUANTILES)


@query(f"""WITH {fix.BASKET}, s AS (SELECT cnt, row_number() OVER (ORDER BY cnt) - 1 AS i, count(*) OVER () AS n FROM vocab),
p(point) AS (VALUES {QUANTILE_SQL}) SELECT point, cnt AS value FROM p JOIN s ON i = CAST(floor(point * (n - 1) / 100000.0) AS BIGINT)""")
def count_quantiles(spark, sf_dir):
    return vocab.quantiles(basket_parts(spark, sf_dir)[1], "cnt")


@query(f"WITH {fix.TABULAR} SELECT col, count(*) AS pairs, count(DISTINCT key) AS names FROM (SELECT DISTINCT col, key FROM tokens) GROUP BY col")
def distinct_feature_names(spark, sf_dir):
    return fix.tabular(spark, sf_dir).tokens.select("col", "key").distinct().groupBy("col").agg(F.count("*").alias("pairs"), F.countDistinct("key").alias("names"))


@query(f"WITH {fix.BASKET} SELECT min(CAST(key AS BIGINT)) AS low, max(CAST(key AS BIGINT)) AS high FROM basket")
def feature_id_range(spark, sf_dir):
    return fix.basket(spark, sf_dir).tokens.agg(F.min(F.col("key").cast("long")).alias("low"), F.max(F.col("key").cast("long")).alias("high"))


# Graph


@query(f"WITH {fix.BASKET} SELECT l, r, freq FROM edges")
def edge_freq(spark, sf_dir):
    return basket_edges(spark, sf_dir)[2]


@query(f"WITH {fix.BASKET} SELECT l, r, freq FROM edges ORDER BY freq DESC, l, r LIMIT 50")
def edge_top_k(spark, sf_dir):
    return basket_edges(spark, sf_dir)[2].orderBy(F.col("freq").desc(), "l", "r").limit(50)


DEGREES = "degrees AS (SELECT v.fid, count(e.o) AS degree FROM vocab v LEFT JOIN (SELECT l AS fid, r AS o FROM edges UNION ALL SELECT r, l FROM edges) e USING (fid) GROUP BY v.fid)"


@query(f"WITH {fix.BASKET}, {DEGREES} SELECT fid, degree FROM degrees")
def vertex_degree(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return graph.degrees(edges, words)


@query(f"""WITH {fix.BASKET}, {DEGREES} SELECT max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree,
CAST(floor(sum(degree) / count(*)) AS BIGINT) AS floor_avg_degree FROM degrees""")
def degree_summary(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return graph.degree_summary(edges, words).select("max_degree", r6("avg_degree").alias("avg_degree"), "floor_avg_degree")


@query(f"""WITH {fix.BASKET}, k(k) AS (VALUES (1), (2), (3), (4)), e AS (SELECT l AS fid, freq FROM edges UNION ALL SELECT r, freq FROM edges),
d AS (SELECT k, fid, count(*) AS degree FROM k JOIN e ON freq >= k GROUP BY 1, 2)
SELECT k.k, coalesce(max(degree), 0) AS max_degree, round(coalesce(sum(degree), 0) / (SELECT count(*) FROM vocab), 6) AS avg_degree FROM k LEFT JOIN d USING (k) GROUP BY k.k""")
def edges_threshold_degree(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return diagnostics.threshold_degrees(edges, words, 4).select("k", "max_degree", r6("avg_degree").alias("avg_degree"))


@query(f"WITH {fix.BASKET} SELECT l, r, freq FROM edges WHERE freq >= 2")
def edges_threshold(spark, sf_dir):
    return graph.threshold(basket_edges(spark, sf_dir)[2], 2)


@query(f"""WITH {fix.BASKET}, k(k) AS (VALUES (1), (2), (3), (4), (5), (6)) SELECT k, round(coalesce(sum(freq), 0) / (SELECT count(*) FROM lines), 6) AS good_turing
FROM k LEFT JOIN edges ON freq <= k GROUP BY k""")
def good_turing_curve(spark, sf_dir):
    data, _, edges = basket_edges(spark, sf_dir)
    return diagnostics.good_turing(edges, data.lines.count(), 6).select("k", r6("good_turing").alias("good_turing"))


@query(f"""WITH {fix.BASKET_SPLIT}, k(k) AS (VALUES (1), (2), (3), (4)), u AS (SELECT coalesce(t.freq, 0) AS f, v.freq AS freq FROM valid v LEFT JOIN train t USING (l, r))
SELECT k, round(coalesce(sum(freq), 0) / (SELECT n FROM n_valid), 6) AS new_edges FROM k LEFT JOIN u ON f < k GROUP BY k""")
def new_edges_curve(spark, sf_dir):
    _, valid, _, seen, fresh = split_edges(spark, sf_dir)
    return diagnostics.new_edges(seen, fresh, valid.lines.count(), 4).select("k", r6("new_edges").alias("new_edges"))


@query(f"WITH {fix.BASKET}, {DEGREES} SELECT max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree FROM degrees WHERE fid >= 20")
def masked_degree(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    kept = graph.masked_degrees(edges, words, words.where("fid < 20"))
    return kept.agg(F.max("degree").alias("max_degree"), r6(F.avg("degree")).alias("avg_degree"))


@query(f"WITH {fix.BASKET} SELECT freq, count(*) AS edges FROM edges WHERE l >= 20 AND r >= 20 GROUP BY freq")
def masked_appeared_k(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return graph.frequency_counts(graph.without(edges, words.where("fid < 20")))


@query(f"""WITH {fix.BASKET} SELECT CAST(count(*) AS BIGINT) AS differences FROM edges WHERE l >= r""")
def edge_validation(spark, sf_dir):
    data, words, edges = basket_edges(spark, sf_dir)
    f = vocab.line_features(data, words)
    joined = f.alias("a").join(f.alias("b"), F.expr("a.ex_id = b.ex_id AND a.fid < b.fid")).groupBy(F.col("a.fid").alias("l"), F.col("b.fid").alias("r")).agg(F.count("*").alias("freq"))
    return graph.edge_differences(edges, joined).agg(F.count("*").alias("differences"))


# Coloring


@query(f"WITH {fix.TABULAR} SELECT col, fid, color FROM vocab")
def tsv_colors(spark, sf_dir):
    return coloring.table_colors(vocab.fit_table_vocab(fix.tabular(spark, sf_dir)))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def greedy_color_validity(spark, sf_dir):
    data, words, edges = basket_edges(spark, sf_dir)
    return diagnostics.color_violations(vocab.line_features(data, words), coloring.color(edges, words)).agg(F.count("*").alias("violations"))


def _greedy(edges: str) -> str:
    """Common table expressions up to ``colors`` (fid, color): one vertex a step, in the order of degrees in ``edges``."""
    return f"""ends AS (SELECT l AS fid, r AS o FROM {edges} UNION ALL SELECT r, l FROM {edges}),
placed AS (SELECT v.fid, row_number() OVER (ORDER BY count(e.o) DESC, v.fid) AS i FROM vocab v LEFT JOIN ends e USING (fid) GROUP BY v.fid),
earlier AS MATERIALIZED (SELECT a.i, list(b.i) FILTER (WHERE b.i < a.i) AS prev FROM placed a LEFT JOIN ends e ON e.fid = a.fid LEFT JOIN placed b ON b.fid = e.o GROUP BY a.i),
steps AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS done UNION ALL
          SELECT e.i, list_append(done, CASE WHEN prev IS NULL THEN 0 ELSE (SELECT min(c) FROM (SELECT unnest(range(len(prev) + 1)) AS c) WHERE NOT list_contains(list_transform(prev, lambda p: done[p]), c)) END)
          FROM steps s JOIN earlier e ON e.i = s.i + 1),
raw AS (SELECT unnest(done) AS c, generate_subscripts(done, 1) AS i FROM (SELECT done FROM steps ORDER BY i DESC LIMIT 1)),
ranks AS (SELECT c, CAST(row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS INTEGER) AS color FROM raw GROUP BY c),
colors AS (SELECT CAST(fid AS INTEGER) AS fid, color FROM placed JOIN raw USING (i) JOIN ranks USING (c))"""


def _recursive(ctes: str) -> str:
    return f"WITH RECURSIVE {ctes}"


@query(f"{_recursive(fix.BASKET)}, {_greedy('edges')} SELECT fid, color FROM colors")
def greedy_color_assignment(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return coloring.color(edges, words)


@query(f"{_recursive(fix.BASKET)}, {_greedy('edges')} SELECT color, count(*) AS n FROM colors GROUP BY color")
def color_class_sizes(spark, sf_dir):
    return diagnostics.class_sizes(greedy_color_assignment(spark, sf_dir))


@query(f"""WITH {fix.BASKET}, x AS (SELECT l.ex_id, coalesce(count(DISTINCT fid) - count(DISTINCT fid % 32), 0) AS x FROM lines l LEFT JOIN features f USING (ex_id) GROUP BY l.ex_id)
SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x""")
def color_collisions_fixed(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    colors = words.select("fid", (F.col("fid") % 32).alias("color"))
    return diagnostics.collisions(vocab.line_features(data, words), data.lines, colors).select(r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""{_recursive(fix.BASKET_SPLIT)}, {_greedy('train')}, x AS (SELECT ex_id, count(DISTINCT fid) - count(DISTINCT color) AS x FROM features JOIN colors USING (fid) GROUP BY ex_id),
l AS (SELECT DISTINCT ex_id FROM basket WHERE ex_id % 10 >= 7) SELECT round(avg(coalesce(x, 0)), 6) AS mean, round(stddev_pop(coalesce(x, 0)), 6) AS std FROM l LEFT JOIN x USING (ex_id)""")
def color_collisions(spark, sf_dir):
    _, valid, words, edges, _ = split_edges(spark, sf_dir)
    found = diagnostics.collisions(vocab.line_features(valid, words), valid.lines, coloring.color(edges, words))
    return found.select(r6("mean").alias("mean"), r6("std").alias("std"))


@query(f"""{_recursive(fix.BASKET)}, ends AS (SELECT l AS fid, r AS o FROM edges UNION ALL SELECT r, l FROM edges),
near AS MATERIALIZED (SELECT v.fid, list(e.o) FILTER (WHERE e.o IS NOT NULL) AS others FROM vocab v LEFT JOIN ends e USING (fid) GROUP BY v.fid),
steps AS (SELECT CAST(0 AS BIGINT) AS position, CAST(-1 AS BIGINT) AS fid, CAST(-1 AS BIGINT) AS degree, (SELECT list(coalesce(len(others), 0) ORDER BY fid) FROM near) AS d UNION ALL
          SELECT s.position + 1, n.fid, list_max(d), list_transform(d, lambda x, j: CASE WHEN j = n.fid + 1 THEN -1 WHEN x > 0 AND list_contains(n.others, j - 1) THEN x - 1 ELSE x END)
          FROM steps s JOIN near n ON n.fid = list_position(d, list_max(d)) - 1 WHERE list_max(d) >= 0)
SELECT CAST(position - 1 AS INTEGER) AS position, CAST(fid AS INTEGER) AS fid, CAST(degree AS INTEGER) AS degree FROM steps WHERE position > 0""")
def largest_first_order(spark, sf_dir):
    _, words, edges = basket_edges(spark, sf_dir)
    return coloring.removal_order(edges, words)


@query()
def filtered_diagnostics(spark, sf_dir):
    train, valid, words, seen, fresh = split_edges(spark, sf_dir)
    return coloring.filtered_diagnostics(seen, fresh, words, train.lines.count(), valid.lines.count(), 3)


@query()
def glauber_collisions(spark, sf_dir):
    """Collisions of sampled colorings of the graph of property words, for several color counts."""
    import numpy as np

    data = fix.user_days(spark, sf_dir)
    words = hold(vocab.fit_vocab(data))
    sparse = words.where("not dense")
    edges = graph.edge_counts(vocab.line_arrays(data, words))
    n = sparse.count()
    adjacency = coloring.collect_graph(edges, n)
    needed = int(coloring.greedy(adjacency).max(initial=0)) + 1
    colors = coloring.glauber_colorings(spark, adjacency, [needed, needed + 5, needed + 20], np.zeros(n, bool))
    per_line = vocab.line_features(data, words).join(colors, "fid").groupBy("ncolors", "ex_id").agg((F.countDistinct("fid") - F.countDistinct("color")).alias("x"))
    total = F.broadcast(data.lines.agg(F.count("*").alias("n")))
    return per_line.groupBy("ncolors").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")).join(total).select(
        "ncolors", (F.col("sx") / F.col("n")).alias("mean"), F.sqrt(F.col("sxx") / F.col("n") - F.pow(F.col("sx") / F.col("n"), 2)).alias("std"))


# Sketches and encoders


@query(f"WITH {fix.TABULAR} SELECT fid, count(*) AS cnt, round(avg(target), 6) AS mean FROM features JOIN lines USING (ex_id) GROUP BY fid")
def mean_sketch(spark, sf_dir):
    data, _, _, found = tabular_parts(spark, sf_dir)
    return encoders.mean_sketch(found, data.lines).select("fid", "cnt", r6("mean").alias("mean"))


SKETCH = "sketch AS (SELECT color, fid, sum(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN target > 0 THEN 0 ELSE 1 END) AS neg FROM features JOIN lines USING (ex_id) GROUP BY 1, 2)"


@query(f"WITH {fix.TABULAR}, {SKETCH} SELECT fid, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM sketch")
def posneg_sketch(spark, sf_dir):
    data, _, _, found = tabular_parts(spark, sf_dir)
    return encoders.class_sketch(found, data.lines)


@query(f"""WITH {fix.TABULAR}, m AS (SELECT fid, color, avg(target) AS val FROM features JOIN lines USING (ex_id) GROUP BY 1, 2),
e AS (SELECT ex_id, f.color AS idx, val FROM features f JOIN m USING (fid) WHERE val <> 0)
SELECT ex_id, target, {SHOW} AS encoded FROM lines JOIN e USING (ex_id) GROUP BY 1, 2""")
def encode_te(spark, sf_dir):
    data, _, colors, found = tabular_parts(spark, sf_dir)
    return shown(encoders.encode(found, data.lines, encoders.fit_target(found, data.lines, colors, 8)))


@query(f"""WITH {fix.BASKET} SELECT ex_id, target, coalesce(string_agg(CAST(fid AS VARCHAR) || ':1.000000', ' ' ORDER BY fid) FILTER (WHERE fid < 100), '') AS encoded
FROM lines LEFT JOIN features USING (ex_id) GROUP BY 1, 2""")
def encode_ft(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    return shown(encoders.encode(vocab.line_features(data, words), data.lines, encoders.fit_frequency(words, 100)))


CODED = """code AS (SELECT fid, color, row_number() OVER (PARTITION BY color ORDER BY fid) AS code FROM vocab {where}),
e AS (SELECT ex_id, f.color AS idx, CAST(max(code) AS DOUBLE) AS val FROM features f JOIN code USING (fid) GROUP BY 1, 2)"""


@query(f"""WITH {fix.TABULAR}, {CODED.format(where="WHERE fid < 20")}
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN e USING (ex_id) GROUP BY 1, 2""")
def encode_faft(spark, sf_dir):
    data, words, colors, found = tabular_parts(spark, sf_dir)
    return shown(encoders.encode(found, data.lines, encoders.fit_field_aware(words, colors, 20)))


@query(f"""WITH {fix.TABULAR}, {CODED.format(where="")}
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN e USING (ex_id) GROUP BY 1, 2""")
def encode_identity(spark, sf_dir):
    data, _, colors, found = tabular_parts(spark, sf_dir)
    return shown(encoders.encode(found, data.lines, encoders.fit_identity(colors, 20)))


@query(f"""WITH {fix.TABULAR} SELECT color AS idx, CAST(count(*) + 1 AS INTEGER) AS dim FROM vocab GROUP BY color
UNION ALL SELECT 3, 1 UNION ALL SELECT 4, 1""")
def field_dims(spark, sf_dir):
    _, _, colors, _ = tabular_parts(spark, sf_dir)
    return encoders.field_dims(encoders.fit_identity(colors, 20), 2)


@query(f"""WITH {fix.TABULAR}, {CODED.format(where="")}, d AS (SELECT * FROM e UNION ALL SELECT ex_id, 3, c_acctbal FROM source UNION ALL SELECT ex_id, 4, o_totalprice FROM source)
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN (SELECT * FROM d WHERE val <> 0) USING (ex_id) GROUP BY 1, 2""")
def encode_with_dense(spark, sf_dir):
    data, _, colors, found = tabular_parts(spark, sf_dir)
    dense = fix.tabular_rows(spark, sf_dir).select(F.col("o_orderkey").alias("ex_id"), F.inline(F.array(
        F.struct(F.lit(0).alias("d"), F.col("c_acctbal").alias("val")), F.struct(F.lit(1).alias("d"), F.col("o_totalprice").alias("val")))))
    return shown(encoders.encode(found, data.lines, encoders.fit_identity(colors, 20, 2), dense))


NULLS = f"""{SKETCH}, tot AS (SELECT sum(CASE WHEN target > 0 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN target > 0 THEN 0 ELSE 1 END) AS n FROM lines),
items AS (SELECT color, fid, pos, neg FROM sketch UNION ALL SELECT color, -1 - color, p - sum(pos), n - sum(neg) FROM sketch, tot GROUP BY color, p, n HAVING p + n > sum(pos) + sum(neg))"""
SPARSE = fix.TABULAR.replace("FROM tokens JOIN vocab USING (col, key))", "FROM tokens JOIN vocab USING (col, key) WHERE key <> '4-NOT SPECIFIED')")


def with_missing(spark, sf_dir):
    """The tabular features; a priority that is not specified is missing, so that its color has a null."""
    data, words, colors, found = tabular_parts(spark, sf_dir)
    return data, colors, found.join(words.where("key <> '4-NOT SPECIFIED'").select("fid"), "fid", "left_semi")


@query(f"WITH {SPARSE}, {NULLS} SELECT color, fid, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM items")
def mi_null_features(spark, sf_dir):
    data, colors, found = with_missing(spark, sf_dir)
    return quantizer.with_nulls(encoders.class_sketch(found, data.lines), colors, encoders.class_totals(data.lines))


CUMULATIVE = """cum AS (SELECT color, fid, row_number() OVER w AS "at", sum(neg) OVER w AS cum_neg, sum(pos + neg) OVER w AS cum_cnt FROM items
WINDOW w AS (PARTITION BY color ORDER BY CAST(neg AS DOUBLE) / (pos + neg), fid ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {SPARSE}, {NULLS}, {CUMULATIVE} SELECT color, fid, \"at\", CAST(cum_neg AS BIGINT) AS cum_neg, CAST(cum_cnt AS BIGINT) AS cum_cnt FROM cum")
def mi_cumulative(spark, sf_dir):
    return quantizer.cumulative(mi_null_features(spark, sf_dir)).select("color", "fid", "at", "cum_neg", "cum_cnt")


def _term(c: str, g: str) -> str:
    return (f"(CASE WHEN {g} > 0 THEN {g} / m * ln({g} / {c} / sh) ELSE 0 END + CASE WHEN {c} - {g} > 0 THEN ({c} - {g}) / m * ln(({c} - {g}) / {c} / (1 - sh)) ELSE 0 END)")


@query(f"""WITH {SPARSE}, {NULLS}, {CUMULATIVE},
x AS (SELECT color, fid, CAST(cum_cnt AS DOUBLE) AS c, CAST(cum_neg AS DOUBLE) AS g, CAST(max(cum_cnt) OVER (PARTITION BY color) AS DOUBLE) AS m,
      CAST(max(cum_neg) OVER (PARTITION BY color) AS DOUBLE) AS a, (SELECT CAST(n AS DOUBLE) / (p + n) FROM tot) AS sh FROM cum)
SELECT color, fid, round(greatest({_term('c', 'g')} + {_term('(m - c)', '(a - g)')} - {_term('m', 'a')}, 0), 6) + 0 AS gain FROM x WHERE c < m""")
def mi_first_split_gain(spark, sf_dir):
    data, _, _ = with_missing(spark, sf_dir)
    found = quantizer.first_gains(mi_null_features(spark, sf_dir), encoders.class_totals(data.lines))
    return found.select("color", "fid", (r6("gain") + 0).alias("gain"))


def _quantized(kind: str):
    def run(spark, sf_dir):
        split = F.col("ex_id") % 2 == 0 if kind in ("sm", "ss") else None
        model = Encoder(kind, 12, split=split).fit(fix.tabular(spark, sf_dir), tabular=True)
        return shown(model.transform(fix.tabular(spark, sf_dir), train=True))

    run.__name__ = f"encode_{kind}"
    run.__doc__ = f"Mutual-information quantization of the tabular data, variant {kind}."
    return run


def _interval(lo: str, hi: str) -> str:
    """An interval's information: counts and negatives between two positions of a color's lists."""
    c, g = f"(cs[{hi} + 1] - cs[{lo} + 1])", f"(gs[{hi} + 1] - gs[{lo} + 1])"
    return f"((CASE WHEN {g} > 0 THEN {g} * ln({g} / {c} / sh) ELSE 0 END + CASE WHEN {c} > {g} THEN ({c} - {g}) * ln(({c} - {g}) / {c} / (1 - sh)) ELSE 0 END) / cs[len(cs)])"


def _quantized_sql(kind: str, slots: int = 9) -> str:
    """Splits one color a row, a split a step; then the best of all colors."""
    estimated, shown_ = ("WHERE ex_id % 2 = 0", "WHERE ex_id % 2 <> 0") if kind in ("sm", "ss") else ("", "")
    marginal = kind in ("ss", "ns")
    below, above = "list_max(list_filter(chosen, lambda x: x < {k}))", "list_min(list_filter(chosen, lambda x: x > {k}))"
    lo, hi = f"coalesce({below.format(k='k')}, 0)", f"coalesce({above.format(k='k')}, len(cs) - 1)"
    gain = f"greatest({_interval('lo', 'k')} + {_interval('k', 'hi')} - {_interval('lo', 'hi')}, 0)"
    candidates = f"(SELECT k, {lo} AS lo, {hi} AS hi FROM (SELECT unnest(range(1, len(cs) - 1)) AS k) WHERE NOT list_contains(chosen, k))"
    best = f"(SELECT max({{'gain': {gain}, 'k': k}}) FROM {candidates})"
    source = f"SELECT color, k, {gain} AS gain FROM (SELECT *, {lo} AS lo, {hi} AS hi FROM (SELECT *, unnest(chosen) AS k FROM last))" if marginal else "SELECT color, pick.k AS k, pick.gain AS gain FROM steps WHERE pick IS NOT NULL"
    return f"""WITH RECURSIVE {fix.TABULAR}, est AS (SELECT * FROM lines {estimated}), {SKETCH.replace("JOIN lines USING", "JOIN est USING")},
items AS (SELECT color, fid, pos, neg FROM sketch), {CUMULATIVE},
tot AS (SELECT CAST(sum(CASE WHEN target > 0 THEN 0 ELSE 1 END) AS DOUBLE) / count(*) AS sh FROM est),
merged AS (SELECT color, max("at") AS "at", CAST(max(cum_cnt) AS DOUBLE) AS c, CAST(max(cum_neg) AS DOUBLE) AS g FROM (SELECT cum.*, round(CAST(neg AS DOUBLE) / (pos + neg), 12) AS ratio FROM cum JOIN items USING (color, fid)) GROUP BY color, ratio),
per AS MATERIALIZED (SELECT color, list_prepend(0.0, list(c ORDER BY "at")) AS cs, list_prepend(0.0, list(g ORDER BY "at")) AS gs, list("at" ORDER BY "at") AS ats, (SELECT sh FROM tot) AS sh FROM merged GROUP BY color),
steps AS (SELECT color, 0 AS n, CAST([] AS BIGINT[]) AS chosen, CAST(NULL AS STRUCT(gain DOUBLE, k BIGINT)) AS pick FROM per UNION ALL
  SELECT color, n + 1, list_append(chosen, pick.k), pick FROM (SELECT color, n, chosen, {best} AS pick FROM (SELECT s.color, s.n, s.chosen, cs, gs, sh FROM steps s JOIN per USING (color) WHERE n < {slots + marginal})) WHERE pick.gain > 1e-12),
last AS (SELECT color, chosen, cs, gs, sh FROM (SELECT *, row_number() OVER (PARTITION BY color ORDER BY n DESC) AS r FROM steps) JOIN per USING (color) WHERE r = 1),
cuts AS (SELECT color, ats[k] AS "at" FROM ({source}) JOIN per USING (color) ORDER BY gain DESC, color DESC, k DESC LIMIT {slots}),
parts AS (SELECT cum.color, cum.fid, count(cuts."at") AS part FROM cum LEFT JOIN cuts ON cuts.color = cum.color AND cuts."at" < cum."at" GROUP BY 1, 2),
starts AS (SELECT color, coalesce(sum(max(part) + 1) OVER (ORDER BY color ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parts GROUP BY color),
e AS (SELECT ex_id, f.color, CAST(max(start + part) AS INTEGER) AS idx, 1.0 AS val FROM features f JOIN parts USING (color, fid) JOIN starts USING (color) GROUP BY 1, 2)
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM (SELECT * FROM lines {shown_}) l LEFT JOIN e USING (ex_id) GROUP BY 1, 2"""


for _kind in ("sm", "sn", "ss", "ns"):
    query(_quantized_sql(_kind))(_quantized(_kind))


@query(f"""{_recursive(fix.BASKET)}, {_greedy('edges')}, m AS (SELECT fid, avg(target) AS val FROM features JOIN lines USING (ex_id) GROUP BY fid),
e AS (SELECT ex_id, color AS idx, val FROM features JOIN m USING (fid) JOIN colors USING (fid) WHERE color < 64 AND val <> 0)
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN e USING (ex_id) GROUP BY 1, 2""")
def encode_graph_te(spark, sf_dir):
    """Mean targets of the basket, colored by its co-occurrence graph."""
    data = fix.basket(spark, sf_dir)
    return shown(Encoder("te", 64, dense_fraction=2).fit(data).transform(data))


@query(f"""WITH {fix.BASKET}, e AS (SELECT ex_id, fid % 64 AS idx, CAST(sum(CASE WHEN fid % 3 = 0 THEN -1 ELSE 1 END) AS DOUBLE) AS val FROM features WHERE fid < 1000 GROUP BY 1, 2)
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN (SELECT * FROM e WHERE val <> 0) USING (ex_id) GROUP BY 1, 2""")
def hashing_trick_mod(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    encoded = encoders.encode(vocab.line_features(data, words), data.lines, encoders.fit_frequency(words, 1000))
    return shown(encoders.hashing_trick(encoded, 64, F.col("idx") % 64, F.when(F.col("idx") % 3 == 0, -1).otherwise(1)))


@query()
def hashing_trick(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    return shown(encoders.hashing_trick(encoders.encode(vocab.line_features(data, words), data.lines, encoders.fit_frequency(words, 1000)), 64))


@query(f"""WITH {fix.BASKET}, n AS (SELECT l.ex_id, target, count(fid) FILTER (WHERE fid < 100) AS n FROM lines l LEFT JOIN features USING (ex_id) GROUP BY 1, 2)
SELECT ex_id, target AS y, CAST(sum(n) OVER (ORDER BY ex_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS indptr FROM n""")
def csr_indptr(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    encoded = encoders.encode(vocab.line_features(data, words), data.lines, encoders.fit_frequency(words, 100))
    return writers.csr_rows(encoded).select("ex_id", "y", "indptr")


@query(f"""WITH {fix.BASKET}, e AS (SELECT ex_id, fid AS idx FROM features WHERE fid < 100 UNION ALL SELECT ex_id, 100 + fid FROM features WHERE fid < 10)
SELECT l.ex_id, target, coalesce(string_agg(CAST(idx AS VARCHAR) || ':1.000000', ' ' ORDER BY idx), '') AS encoded FROM lines l LEFT JOIN e USING (ex_id) GROUP BY 1, 2""")
def stack_columns(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    found = vocab.line_features(data, words)
    left = encoders.encode(found, data.lines, encoders.fit_frequency(words, 100))
    right = encoders.encode(found, data.lines, encoders.fit_frequency(words, 10))
    return shown(writers.stack_columns(left, right, 100))


@query(f"WITH {fix.BASKET} SELECT 'ft' AS kind, 100 AS width, count(*) AS nsparse, min(cnt) FILTER (WHERE fid < 100) AS least_count FROM vocab")
def budget_report(spark, sf_dir):
    words = basket_parts(spark, sf_dir)[1]
    return encoders.budget_report(encoders.fit_frequency(words, 100), words)


@query(f"""WITH {fix.TABULAR}, {SKETCH}, q AS (SELECT floor(100.0 * pos / (pos + neg)) / 100 AS v FROM sketch),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM q), p(point) AS (VALUES {QUANTILE_SQL})
SELECT point, round(v, 6) AS value FROM p JOIN s ON i = CAST(floor(point * (n - 1) / 100000.0) AS BIGINT)""")
def positive_share_quantiles(spark, sf_dir):
    share = posneg_sketch(spark, sf_dir).select((F.floor(100.0 * F.col("pos") / (F.col("pos") + F.col("neg"))) / 100).alias("v"))
    return vocab.quantiles(share, "v").select("point", r6("value").alias("value"))


def _quantiles(source: str) -> str:
    return f"""s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM ({source})), p(point) AS (VALUES {QUANTILE_SQL})
SELECT point, CAST(v AS BIGINT) AS value FROM p JOIN s ON i = CAST(floor(point * (n - 1) / 100000.0) AS BIGINT)"""


@query(f"WITH {fix.BASKET}, {_quantiles('SELECT freq AS v FROM edges')}")
def edge_frequency_quantiles(spark, sf_dir):
    return vocab.quantiles(basket_edges(spark, sf_dir)[2], "freq").select("point", F.col("value").cast("long").alias("value"))


@query(f"WITH {fix.TABULAR}, {_quantiles('SELECT count(*) AS v FROM features GROUP BY fid')}")
def feature_count_quantiles(spark, sf_dir):
    data, _, _, found = tabular_parts(spark, sf_dir)
    return vocab.quantiles(encoders.mean_sketch(found, data.lines), "cnt").select("point", F.col("value").cast("long").alias("value"))


@query(f"WITH {fix.TABULAR}, {SKETCH}, {_quantiles('SELECT pos + neg AS v FROM sketch')}")
def class_count_quantiles(spark, sf_dir):
    both = posneg_sketch(spark, sf_dir).select((F.col("pos") + F.col("neg")).alias("v"))
    return vocab.quantiles(both, "v").select("point", F.col("value").cast("long").alias("value"))


@query(f"""WITH {fix.TABULAR}, {CODED.format(where="")}, d AS (SELECT * FROM e UNION ALL SELECT ex_id, 3, c_acctbal FROM source UNION ALL SELECT ex_id, 4, o_totalprice FROM source)
SELECT l.ex_id, target, coalesce({SHOW}, '') AS encoded FROM lines l LEFT JOIN (SELECT * FROM d WHERE val <> 0) USING (ex_id) GROUP BY 1, 2""")
def encode_tabular_dense(spark, sf_dir):
    """The estimator on tabular data two columns of which are numbers."""
    dense = ["c_acctbal", "o_totalprice"]
    data = readers.from_columns(fix.tabular_rows(spark, sf_dir), "o_orderkey", F.col("o_orderstatus") == "F", [*fix.TABULAR_COLUMNS, *dense])
    return shown(Encoder("id", 20, dense_columns=dense).fit(data, tabular=True).transform(data))


@query(f"""WITH {fix.BASKET} SELECT 'ft' AS kind, CAST(b AS INTEGER) AS budget, CAST(b AS BIGINT) AS width, count(fid) AS entries
FROM (VALUES (10), (100), (1000)) g(b) LEFT JOIN features ON fid < b GROUP BY b""")
def encoding_grid(spark, sf_dir):
    return run.encoding_grid(fix.basket(spark, sf_dir), ["ft"], [10, 100, 1000], dense_fraction=2)


@query(f"""WITH {fix.BASKET}, {DEGREES} SELECT (SELECT count(*) FROM lines) AS nlines, (SELECT count(*) FROM basket) AS nwords, (SELECT count(*) FROM vocab) AS nfeatures,
(SELECT max(n) FROM (SELECT count(*) AS n FROM features GROUP BY ex_id)) AS max_nnz, (SELECT count(*) FROM features) // (SELECT count(*) FROM lines) AS avg_nnz,
(SELECT max(degree) FROM degrees) AS max_degree, 32 AS ncolors""")
def dataset_summary(spark, sf_dir):
    data, words, edges = basket_edges(spark, sf_dir)
    found = run.summary(data, words, edges, words.select("fid", (F.col("fid") % 32).alias("color")))
    return found.select("nlines", "nwords", "nfeatures", "max_nnz", "avg_nnz", "max_degree", F.col("ncolors").cast("int").alias("ncolors"))


@query(f"""WITH {fix.BASKET}, c AS (SELECT ex_id, fid % 32 AS color FROM features GROUP BY ex_id, fid % 32 HAVING count(DISTINCT fid) > 1) SELECT ex_id, CAST(color AS INTEGER) AS color FROM c""")
def color_conflicts(spark, sf_dir):
    """Lines on which an arbitrary coloring is not valid."""
    data, words = basket_parts(spark, sf_dir)
    return diagnostics.color_violations(vocab.line_features(data, words), words.select("fid", (F.col("fid") % 32).alias("color"))).select("ex_id", F.col("color").cast("int").alias("color"))


# Scalar preparation, splits and reports


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(CASE WHEN l_quantity = 0 THEN 0 ELSE ln(l_quantity + 4) END, 6) AS q,
round(CASE WHEN l_discount = 0 THEN 0 ELSE ln(l_discount + 1) END, 6) AS d FROM lineitem""")
def log_scale(spark, sf_dir):
    t = fix.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6(fx.log_scale(F.col("l_quantity"), 4)).alias("q"), r6(fx.log_scale(F.col("l_discount"))).alias("d"))


@query("""SELECT l_orderkey, l_partkey, concat_ws(' ', CASE WHEN CAST(l_quantity AS INT) <> 0 THEN '0:' || CAST(l_quantity AS INT) END,
CASE WHEN CAST(round(l_discount * 100) AS INT) <> 0 THEN '1:' || CAST(round(l_discount * 100) AS INT) END,
CASE WHEN CAST(round(l_tax * 100) AS INT) <> 0 THEN '2:' || CAST(round(l_tax * 100) AS INT) END) AS line FROM lineitem""")
def svmify(spark, sf_dir):
    t = fix.table(spark, sf_dir, "lineitem")
    whole = [F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int")]
    return t.select("l_orderkey", "l_partkey", F.concat_ws(" ", *(fx.svm_pair(i, x) for i, x in enumerate(whole))).alias("line"))


@query("SELECT 'l_quantity' AS name, min(l_quantity) + 0 AS low FROM lineitem UNION ALL SELECT 'l_discount', min(l_discount) + 0 FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax) + 0 FROM lineitem")
def column_minima(spark, sf_dir):
    low = reports.column_minima(fix.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return low.select("name", (F.col("low") + 0).alias("low"))  # no negative zero


@query("SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1")
def value_histogram(spark, sf_dir):
    return fix.table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count("*").alias("n"))


@query(f"WITH {fix.TABULAR} SELECT CAST(CASE WHEN target > 0 THEN 1 ELSE -1 END AS INTEGER) AS label, count(*) AS n FROM lines GROUP BY 1")
def label_distribution(spark, sf_dir):
    return fix.tabular(spark, sf_dir).lines.groupBy(fx.signed_label(F.col("target")).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, CASE WHEN i <= 600 THEN 'train' ELSE 'valid' END AS part FROM r""")
def chrono_split(spark, sf_dir):
    events = fix.table(spark, sf_dir, "events").select("event_id", "ts")
    return reports.chronological_split(events, [F.col("ts"), F.col("event_id")], 600).select("event_id", "part")


@query("""WITH r AS (SELECT event_id, percent_rank() OVER (ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, CASE WHEN i < 0.7 THEN 'train' ELSE 'valid' END AS part FROM r""")
def positional_split(spark, sf_dir):
    return reports.positional_split(fix.table(spark, sf_dir, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 0.7).select("event_id", "part")


@query("""SELECT ex_id, substr(md5(array_to_string(list_sort(list(key)), chr(31))), 8, 1) IN ('0', '4', '8', 'c') AS estimation
FROM (SELECT l_orderkey AS ex_id, CAST(l_partkey AS VARCHAR) AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ex_id""")
def content_split(spark, sf_dir):
    """Lines whose content hash puts them into the estimation quarter."""
    words = fix.basket(spark, sf_dir).tokens.groupBy("ex_id").agg(F.sort_array(F.collect_list("key")).alias("w"))
    return words.select("ex_id", fx.estimation_half(F.col("w"), 2).alias("estimation"))


SCORED = "scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round((l_quantity + 10 * l_discount) / 52, 4) AS p FROM lineitem)"


@query(f"""WITH {SCORED}, r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scored)
SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
round(avg(-ln(CASE WHEN y > 0 THEN greatest(least(p, 1 - 1e-15), 1e-15) ELSE 1 - greatest(least(p, 1 - 1e-15), 1e-15) END)), 6) AS logloss,
round((sum(rk) FILTER (WHERE y > 0) - sum(y) * (sum(y) + 1) / 2.0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 6) AS auc FROM r""")
def classification_metrics(spark, sf_dir):
    t = fix.table(spark, sf_dir, "lineitem")
    scored = t.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round((F.col("l_quantity") + 10 * F.col("l_discount")) / 52, 4).alias("p"))
    return learners.metrics(scored).select("n", r6("accuracy").alias("accuracy"), r6("logloss").alias("logloss"), r6("auc").alias("auc"))


@query("""WITH p AS (SELECT p_brand, min(p_retailprice) FILTER (WHERE p_type = 'ECONOMY') AS ECONOMY, min(p_retailprice) FILTER (WHERE p_type = 'SMALL') AS SMALL,
min(p_retailprice) FILTER (WHERE p_type = 'STANDARD') AS STANDARD FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD') GROUP BY p_brand)
SELECT *, CASE WHEN ECONOMY = least(ECONOMY, SMALL, STANDARD) THEN 'ECONOMY' WHEN SMALL = least(ECONOMY, SMALL, STANDARD) THEN 'SMALL'
WHEN STANDARD = least(ECONOMY, SMALL, STANDARD) THEN 'STANDARD' END AS best FROM p""")
def result_pivot_best(spark, sf_dir):
    kinds = ["ECONOMY", "SMALL", "STANDARD"]
    return reports.best_by(fix.table(spark, sf_dir, "part").where(F.col("p_type").isin(kinds)), ["p_brand"], "p_type", "p_retailprice", kinds)


@query("""SELECT g.p_brand, g.p_type FROM (SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_type FROM part)) g
WHERE NOT EXISTS (SELECT 1 FROM part d WHERE d.p_size > 48 AND d.p_brand = g.p_brand AND d.p_type = g.p_type)""")
def finished_run_anti_join(spark, sf_dir):
    part = fix.table(spark, sf_dir, "part")
    cells = reports.grid(part.select("p_brand").distinct(), part.select("p_type").distinct())
    return readers.finished_runs(cells, part.where("p_size > 48"), ["p_brand", "p_type"])


@query("SELECT p_brand, p_size, round(avg(p_retailprice), 6) AS mean, min(p_retailprice) AS low, max(p_retailprice) AS high, count(*) AS n FROM part GROUP BY 1, 2")
def result_curve(spark, sf_dir):
    return reports.curve(fix.table(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", "p_size", r6("mean").alias("mean"), "low", "high", "n")


@query("SELECT s_suppkey, 's_nationkey' AS variable, CAST(s_nationkey AS DOUBLE) AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
def wide_to_long(spark, sf_dir):
    t = fix.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return reports.wide_to_long(t, ["s_suppkey"], ["s_nationkey", "s_acctbal"])


@query(f"""WITH {fix.BASKET}, {DEGREES}, s AS (SELECT (SELECT max(degree) FROM degrees) AS max_degree, (SELECT sum(freq) FILTER (WHERE freq = 1) FROM edges) / (SELECT count(*) FROM lines) AS good_turing,
(SELECT max(n) FROM (SELECT count(*) AS n FROM features GROUP BY ex_id)) AS max_nnz, (SELECT count(*) FROM lines) AS n_train)
SELECT max_degree, round(good_turing, 6) AS good_turing, max_nnz, n_train, round(2 * max_degree + good_turing + max_nnz * max_nnz / sqrt(n_train) * ln(100.0), 6) AS color_bound FROM s""")
def color_bound(spark, sf_dir):
    data, words, edges = basket_edges(spark, sf_dir)
    n = data.lines.count()
    stats = graph.degree_summary(edges, words).select("max_degree").join(diagnostics.good_turing(edges, n, 1).select("good_turing"))
    stats = stats.join(vocab.line_stats(vocab.line_arrays(data, words)).select("max_nnz", F.col("nlines").alias("n_train"))).withColumn("masked", F.lit(0))
    return diagnostics.color_bound(stats).select("max_degree", r6("good_turing").alias("good_turing"), "max_nnz", "n_train", r6("color_bound").alias("color_bound"))


@query(f"""WITH {fix.BASKET}, p AS (SELECT fid, CAST(cnt AS DOUBLE) / (SELECT count(*) FROM lines) AS p FROM vocab)
SELECT round(sum(x), 6) AS expected FROM (SELECT fid % 64 AS b, sum(p) - 1 + product(1 - p) AS x FROM p GROUP BY 1)""")
def random_bucket_collisions(spark, sf_dir):
    data, words = basket_parts(spark, sf_dir)
    n = F.broadcast(data.lines.agg(F.count("*").alias("n")))
    p = words.join(n).select("fid", (F.col("cnt") / F.col("n")).alias("p"))
    return diagnostics.random_bucket_collisions(p, F.col("fid") % 64).select(r6("expected").alias("expected"))


@query()
def synthetic_data(spark, sf_dir):
    """Line counts by feature of generated data beside their expectation."""
    _, hits = learners.synthetic(spark, 5000, 400, 20, 64)
    p = learners.probabilities(spark, 400, 20, 64)
    return p.join(hits.groupBy("fid").agg(F.count("*").alias("n")), "fid", "left").select("fid", (5000 * F.col("p")).alias("expected"), F.coalesce("n", F.lit(0)).alias("n"))


def _learnt(name: str, **options):
    def run(spark, sf_dir):
        data = fix.tabular(spark, sf_dir)
        encoded = Encoder("sn", 16).fit(data, tabular=True).transform(data)
        rows = learners.vectors(encoded, 16)
        train, test = rows.where(F.col("ex_id") % 10 < 7), rows.where(F.col("ex_id") % 10 >= 7)
        return learners.metrics(learners.predictions(learners.learner(name, iterations=5, **options).fit(train), test))

    run.__name__ = "learn_" + "_".join([name, *options])
    run.__doc__ = f"Test metrics of {name} on quantized tabular data."
    return run


for _name, _options in (("lr", {}), ("lr", {"quadratic": True}), ("gbt", {}), ("gbt", {"categories": 4}), ("fm", {})):
    query()(_learnt(_name, **_options))
