import random
import re

import xxhash

from chromafold.llm.quality import apply_rules, verdicts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def gram_hash(ws):
    h = 42
    for w in ws:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return signed(h)


def brute(rows, min_docs, min_share, max_removed):
    stats = {}
    by_line, hosts = {}, {}
    for i, text, host in rows:
        text = text or ""
        w = WORD.findall(text)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
        full = [x for x in text.split("\n") if WORD.search(x)]
        norm = [x for x in (re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).lower().strip(" ") for x in text.split("\n")) if x]
        sig = min(map(gram_hash, grams)) if grams else ("text", text)
        stats[i] = [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered), norm, host]
        hosts.setdefault(host, set()).add(sig)
        for x in norm:
            by_line.setdefault((host, x), set()).add(sig)
    out = {}
    for i, (*base, norm, host) in stats.items():
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        gone = [x for x in norm if len(by_line[host, x]) >= max(min_docs, min_share * len(hosts[host]))]
        depleted = sum(map(len, gone)) > max_removed * sum(map(len, norm))
        out[i] = (*base, failed, not failed and not depleted, len(gone))
    return out


def fixture():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    footer, rows = "All rights\tReserved  #1 of the common footer lines in this host", []
    for i in range(60):
        body = [line(rnd.randint(3, 12)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            body.append(footer if i % 2 else footer.upper())
        if i % 7 == 0:
            body += [body[0], "  ", body[0]]
        rows.append((i, "\n".join(body), rnd.choice(["h1", "h2", None])))
    rows += [(100 + k, footer + "\nx y", "h1") for k in range(3)] + [(104 + k, footer + "\n" + line(1), "h1") for k in range(9)]
    copied = line(30) + "\n" + line(20)
    rows += [(200 + k, copied, "h1") for k in range(30)]
    return rows + [(300, None, "h1"), (301, "", None), (302, "a b c d e " * 400, "h2"), (303, " \t\n\n", "h2"), (304, "x" * 50000, "h1"), (305, "same five words here ok\r\nsame five words here ok", "h2")]


def test_verdicts_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_words int, h string").repartition(3)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_lines)
           for r in verdicts(df, min_docs=5, min_share=0.1, max_removed=0.6).collect()}
    want = brute(rows, 5, 0.1, 0.6)
    assert got == want
    assert any(w[-1] for w in want.values()) and any(not w[5] and not w[6] for w in want.values())
    assert all(got[200 + k][6] for k in range(30))  # copies of a clean document stay


def test_apply_keeps_columns_and_removes_lines(spark):
    df = spark.createDataFrame(fixture(), "doc_id long, text string, source string")
    want = brute(fixture(), 5, 0.1, 0.6)
    out = apply_rules(df, min_docs=5, min_share=0.1, max_removed=0.6)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {i for i, w in want.items() if w[6]}
    texts = {i: t for i, t, _ in fixture()}
    for i, t in got.items():
        assert (t == texts[i]) == (want[i][-1] == 0)


def test_repeated_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f g h i j", None), (1, "p q r s t u v w x y", "h"), (1, "p q r s t u v w x y", "h")], "doc_id long, text string, source string")
    assert [r.kept for r in verdicts(df).collect()] == [True] * 3
    assert apply_rules(df).count() == 3
    assert verdicts(df.limit(0)).collect() == []


def test_documents_that_are_mostly_boilerplate_count_each(spark):
    rnd = random.Random(7)
    own = lambda: " ".join(f"own{rnd.randrange(10**6)}" for _ in range(12))
    shared = "\n".join(" ".join(f"shared{10 * k + i}" for i in range(10)) for k in range(10))
    rows = [(i, f"{shared}\n{own()}", "h") for i in range(40)] + [(100 + i, own(), "h") for i in range(40)]
    got = {r.doc_id: r for r in verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[i].kept and got[i].removed_lines == 10 for i in range(40))
    assert all(got[100 + i].kept and got[100 + i].removed_lines == 0 for i in range(40))
