import hashlib
import random
import re

from chromafold.llm.pii import estimate, find_spans, logistic, redact

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def texts():
    rnd = random.Random(6)
    bits = ["a.b%c@d-e.f.g", "x@y", "@", "é", "😀 ", "1.2.3.4", "256.1.1.1", "001.002.3.255", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (476) 555-6237", "+12345678", "+1234567890123456", " ", "\n", "12", "3.", "foo", "_", "token = \"5c51a969b7d2926f0a4a7f0bbc8ace16\"",
            "password=dd605f4e45f5f1b466", "a@b.c_foo@bar.com", "-", "..", "5555666677778884", "0" * 30, "+", "(", "page: 12", "v1.2"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14))) for _ in range(300)]
    return [None, "", "1" * 60000, "a" * 60000, "a." * 20000, "1 " * 20000, "+" * 50000, "@" * 1000, *out]


def test_base_spans_match_brute_force(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_ip int, c string").repartition(4)
    got = {r.doc_id: r for r in find_spans(df).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, (t or "")[:300], want, got[i].spans)
        spans = got[i].spans.split(",") if got[i].spans else []
        assert [s for s in spans if not s.startswith("secret")] == want
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(w.startswith(k + ":") for w in want) for k in BASE)


def test_secrets_are_learnt_and_clean_numbers_left(spark):
    rnd = random.Random(1)
    hexes = ["".join(rnd.choice("0123456789abcdef") for _ in range(n)) for n in (18, 40, 24, 32)]
    rows = [(i, f"the word goes password={hexes[i % 4]} on and token = \"{hexes[(i + 1) % 4]}\" end") for i in range(40)]
    rows += [(100 + i, f"in {1900 + i} there were {i} apples, page: {i}, and 3.{i} more; room b{i} is open") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in find_spans(df).collect():
        text = dict(rows)[r.doc_id]
        found = [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s]
        assert found == ([hexes[r.doc_id % 4], hexes[(r.doc_id + 1) % 4]] if r.doc_id < 100 else [])


def test_redact(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co, call +1 (476) 555-6237 or 1.2.3.4!", "x"), (2, None, None), (2, "clean", "y"), (2, "clean", "y")], "doc_id long, text string, _email string")
    out = redact(df)
    assert out.columns == ["doc_id", "text", "_email"] and {r._email for r in out.collect()} == {"x", None, "y"}
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == [(1, "é mail [EMAIL], call [PHONE] or [IP]!"), (2, "clean"), (2, "clean"), (2, None)]
    assert redact(df.drop("_email").limit(0)).collect() == [] and find_spans(df.limit(0)).collect() == []


def test_estimation_ranks_labelers():
    rnd = random.Random(3)
    counts = {}
    for _ in range(4000):
        true = rnd.random() < 0.3
        v = tuple((1 if (true == (rnd.random() < acc)) else -1) if rnd.random() < 0.8 else 0 for acc in (0.95, 0.8, 0.6))
        counts[v] = counts.get(v, 0) + 1.0
    share, tables, posterior = estimate(counts)
    assert abs(share - 0.3) < 0.08
    good = [t[1][0] / t[1][1] for t in tables]
    assert good[0] > good[1] > good[2] > 1
    assert posterior[1, 1, 1] > 0.9 > 0.1 > posterior[-1, -1, -1]


def test_logistic_fits_soft_labels():
    w = logistic([((0, 0), 0.05, 50.0), ((1, 0), 0.9, 30.0), ((0, 1), 0.1, 40.0)])
    assert w[0] > 1.5 and abs(w[1]) < 1.5 and w[2] < -1
