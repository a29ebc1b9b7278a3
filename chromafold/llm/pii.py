"""Personal data by weak supervision, in DataFrame functions only.

Exact patterns with checks (part values, Luhn, digit counts) give the base spans. What they cannot express,
secrets in running text, is learnt without labels: every token with a digit is a candidate; a pattern, a
gazetteer, a context and a variety labeler each vote for, against, or abstain. Expectation-maximisation over
the counts of vote patterns (at most 3**4 rows) estimates how reliable each labeler is, and the posterior of
each pattern trains a logistic classifier over token features (at most 2**8 feature rows). Its weights become
a column expression; candidates that score above ``threshold`` and touch no base span are added as ``secret``.

Defined cases: null text counts as empty and has no spans; null ids are carried; repeated rows get equal
results; very long texts are read whole; of overlapping spans ``redact`` keeps the first, of those the longest;
an empty table gives an empty result and adds nothing; other input columns are kept by ``redact``
and ignored by ``find_spans``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chromafold.llm.columns import let, unpacked, whole_row
from chromafold.llm.lineage import hold

#: Patterns as Java runs them: possessive where backing off cannot help, and tried only where a match can
#: start (the start of a run, or the end of the last match), so that long runs cost linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = (r"(?<![A-Za-z0-9+/_.@%-])(?:([A-Za-z][A-Za-z_-]{1,19}+)\x20?[=:]\x20?(\"|')?)?+"
         r"([A-Za-z+/_.@%-]*+[0-9][A-Za-z0-9+/_.@%-]*+)")
KINDS = ("email", "ip", "card", "phone", "secret")
#: Words that name a secret, and words that name a harmless number.
SECRET_KEYS = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "key", "pin", "ssn", "iban", "passport"]
HARMLESS_KEYS = ["page", "chapter", "section", "figure", "table", "version", "vol", "year", "date", "time", "isbn", "doi", "no", "nr", "item", "step", "line"]
LABELERS = ("pattern", "gazetteer", "context", "variety")
FEATURES = ("keyed", "secret_key", "quoted", "long", "very_long", "hex", "mixed", "dotted")


def running_starts(lengths: Column, block: int = 256) -> Column:
    """For each entry the sum of those before it; sums of blocks keep long arrays from costing quadratic time."""
    def add(a: Column, x: Column) -> Column:
        return a + x

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), add)

    def starts(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: total(F.slice(v, k * block + 1, F.lit(block))))
        return let(blocks, lambda b: F.transform(v, lambda _, i: total(F.slice(b, F.lit(1), F.floor(i / block).cast("int")))
                                                 + total(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block))))

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(let(lengths, starts))


def matches(text: Column, pattern: str, guard: str) -> Column:
    """array<struct<s, e, x>> of all matches with their code-point ranges; texts without ``guard`` are not scanned."""
    def ranges(found: Column, gaps: Column) -> Column:
        lengths = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda z: F.array(F.char_length(z["g"]), F.char_length(z["m"]))))
        return let(running_starts(F.filter(lengths, lambda x: x.isNotNull())), lambda at: F.transform(found, lambda x, i: F.struct(
            at[2 * i + 1].alias("s"), (at[2 * i + 1] + F.char_length(x)).alias("e"), x.alias("x"))))

    def scan(found: Column) -> Column:
        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: ranges(found, gaps))).otherwise(empty)

    empty = F.array().cast("array<struct<s:int,e:int,x:string>>")
    return F.when(text.rlike(guard), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), scan)).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    digits = F.filter(F.split(F.reverse(_digits(x)), ""), lambda d: d != "")
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(x: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(F.char_length(plain) <= 3, plain.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(x, r"\."), small)


def base_spans(text: Column) -> list[Column]:
    """One array of checked matches for each of the first four kinds."""
    card = F.filter(matches(text, CARD, "[0-9]"), lambda m: F.char_length(_digits(m["x"])).between(13, 19))
    return [
        matches(text, EMAIL, "@"),
        F.filter(matches(text, IP, r"[0-9]\."), lambda m: _octets(m["x"])),
        F.filter(card, lambda m: _luhn(m["x"])),
        F.filter(matches(text, PHONE, r"\+[0-9]"), lambda m: F.char_length(_digits(m["x"])).between(9, 15)),
    ]


def candidates(text: Column) -> Column:
    """array<struct<s, e, x, key, quoted>> of the tokens with a digit; key: the word before ``=`` or ``:``."""
    def token(m: Column) -> Column:
        value = F.regexp_extract(m["x"], r"[A-Za-z0-9+/_.@%-]+$", 0)
        kept = F.regexp_replace(value, r"[^A-Za-z0-9]+$", "")
        start = m["e"] - F.char_length(value)
        return F.struct(start.alias("s"), (start + F.char_length(kept)).alias("e"), kept.alias("x"),
                        F.lower(F.regexp_extract(m["x"], r"^([A-Za-z][A-Za-z_-]*)\x20?[=:]", 1)).alias("key"), m["x"].rlike("[\"']").alias("quoted"))

    return F.transform(matches(text, TOKEN, "[0-9]"), token)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(c: Column) -> dict[str, Column]:
    x, key = c["x"], c["key"]
    kinds = F.size(F.array_distinct(F.split(x, "")))
    return {
        "pattern": _vote(x.rlike("^(?=.*[A-Za-z])(?=.*[0-9])[A-Za-z0-9+/_-]{16,}$"), (F.char_length(x) < 8) | x.rlike("^[0-9.,%-]+$")),
        "gazetteer": _vote(key.isin(SECRET_KEYS), key.isin(HARMLESS_KEYS)),
        "context": _vote((key != "") & (c["quoted"] | x.rlike("[A-Za-z]")), key == ""),
        "variety": _vote(kinds >= 9, kinds <= 5),
    }


def features(c: Column) -> dict[str, Column]:
    x = c["x"]
    return {
        "keyed": c["key"] != "", "secret_key": c["key"].isin(SECRET_KEYS), "quoted": c["quoted"], "long": F.char_length(x) >= 8,
        "very_long": F.char_length(x) >= 16, "hex": x.rlike("^[0-9a-fA-F]+$"), "mixed": x.rlike("[A-Za-z]") & x.rlike("[0-9]"), "dotted": x.rlike("[.@/%]"),
    }


def estimate(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[float, list[dict[int, tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns the share of true spans, for each labeler its vote's probability given a true and a false span,
    and the posterior of each pattern. Votes start as an unweighted majority, which fixes what "true" means.
    """
    posterior = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v in patterns}
    n = len(next(iter(patterns), ()))
    share, tables = 0.5, []
    for _ in range(rounds if patterns else 0):
        total = sum(patterns.values())
        true = sum(k * posterior[v] for v, k in patterns.items())
        share = min(max(true / total, 1e-6), 1 - 1e-6)
        tables = []
        for i in range(n):
            table = {}
            for vote in (-1, 0, 1):
                a = sum(k * posterior[v] for v, k in patterns.items() if v[i] == vote)
                b = sum(k * (1 - posterior[v]) for v, k in patterns.items() if v[i] == vote)
                table[vote] = (a + 1) / (true + 3), (b + 1) / (total - true + 3)
            tables.append(table)
        for v in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(t[x][0] / t[x][1]) for t, x in zip(tables, v, strict=True))
            posterior[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return share, tables, posterior


def logistic(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights (the last is the intercept) fitted to (features, soft label, count) rows by gradient descent."""
    size = len(rows[0][0]) + 1 if rows else 1
    w, total = [0.0] * size, sum(k for *_, k in rows) or 1.0
    for _ in range(rounds):
        grad = [ridge * x for x in w[:-1]] + [0.0]
        for f, y, k in rows:
            z = w[-1] + sum(a * b for a, b in zip(w, f, strict=False))
            d = (1 / (1 + math.exp(-max(-50.0, min(50.0, z)))) - y) * k / total
            for i, x in enumerate((*f, 1)):
                grad[i] += d * x
        w = [a - 4 * rate * g for a, g in zip(w, grad, strict=True)]
    return w


def train(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """Weights of the span classifier, learnt from the labelers' votes over all documents; None without candidates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.explode(candidates(text)).alias("c"))
    c = F.col("c")
    counted = found.select(*(v.alias(f"v_{k}") for k, v in votes(c).items()), *(f.cast("int").alias(f"f_{k}") for k, f in features(c).items()))
    counted = hold(counted.groupBy(*counted.columns).agg(F.count("*").alias("n")))  # a few hundred rows
    names_v, names_f = [f"v_{k}" for k in LABELERS], [f"f_{k}" for k in FEATURES]
    patterns = {tuple(r[k] for k in names_v): float(r["n"]) for r in counted.groupBy(*names_v).agg(F.sum("n").alias("n")).collect()}
    if not patterns:
        return None
    _, _, posterior = estimate(patterns)
    soft = F.create_map(*(F.lit(x) for v, p in posterior.items() for x in (",".join(map(str, v)), float(p))))
    labelled = counted.select(*names_f, "n", F.element_at(soft, F.concat_ws(",", *(F.col(k).cast("string") for k in names_v))).alias("y"))
    rows = labelled.groupBy(*names_f).agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n")).collect()
    return logistic(sorted((tuple(r[k] for k in names_f), r["y"], float(r["n"])) for r in rows))


def _score(c: Column, weights: list[float]) -> Column:
    z = F.lit(weights[-1])
    for w, f in zip(weights, features(c).values(), strict=False):
        z = z + F.when(f, w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def _spans(docs: DataFrame, text: Column, weights: list[float] | None, threshold: float) -> DataFrame:
    """``docs`` with the arrays _email, _ip, _card, _phone and _secret."""
    names = [f"_{k}" for k in KINDS]
    out = docs.select("*", *(x.alias(n) for x, n in zip(base_spans(text), names[:4], strict=True)))
    if weights is None:
        return out.withColumn(names[4], F.array().cast("array<struct<s:int,e:int,x:string>>"))
    def free(c: Column) -> Column:
        return ~F.exists(F.concat(*names[:4]), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))

    secret = F.filter(candidates(text), lambda c: (_score(c, weights) >= threshold) & free(c))
    return out.withColumn(names[4], F.transform(secret, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["x"].alias("x"))))


def _named(kinds: tuple[str, ...]) -> Column:
    def names(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.concat_ws(":", F.lit(kind), m["s"].cast("string"), m["e"].cast("string")))

    return F.array_join(F.concat(*map(names, kinds)), ",")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans as kind:start:end."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = _spans(source, text, train(docs, text_col), threshold)
    return out.select("doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
                      F.sha2(_named(KINDS[:4]), 256).alias("base_sha256"), _named(KINDS).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(whole_row(docs).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = _spans(source, text, train(docs, text_col), threshold)

    def ranged(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("ne"), F.lit(kind).alias("k")))

    every = F.sort_array(F.concat(*map(ranged, KINDS)))

    def apart(a: Column, m: Column) -> Column:
        start = F.greatest(m["s"], a["end"])
        taken = F.when(m["s"] >= a["end"], F.concat(a["out"], F.substring(text, a["end"] + 1, start - a["end"]), F.lit("["), F.upper(m["k"]), F.lit("]"))).otherwise(a["out"])
        return F.struct(F.greatest(a["end"], -m["ne"]).alias("end"), taken.alias("out"))

    first = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    cut = F.aggregate(every, first, apart, lambda a: F.concat(a["out"], F.substring(text, a["end"] + 1, F.char_length(text) - a["end"])))
    touched = F.size(F.concat(*(f"_{k}" for k in KINDS))) > 0
    return found.select(*unpacked(found, **{text_col: F.when(touched, cut).otherwise(F.col("row").getField(text_col))}))
