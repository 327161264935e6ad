"""Collocations against plain counts of every phrase."""
import random
import re
from collections import Counter

from vitalgrid.llm.collocations import Graph, collocations, passages

KIND = "doc_id long, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    return f, n


def plain(rows, least=30, top=2000, share=80):
    f, n = plain_counts(rows)
    found = {}
    often = [(g, a) for g, a in f.items() if len(g[1]) > 1 and a >= least]
    over = Counter()
    for (lang, w), a in often:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                over[lang, w[i:i + k]] = max(over[lang, w[i:i + k]], a)
    for (lang, w), a in often:
        if 100 * over[lang, w] >= share * a and over[lang, w]:
            continue
        score, _, left, right = min((2000000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, len(w)))
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in found.items() for r, (s, a, p, x, y) in enumerate(sorted(all_)[:top], 1))


def got(spark, rows, parts=3, **more):
    df = collocations(spark.createDataFrame(rows, KIND).repartition(parts), **more)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def corpus(seed=1, n=200):
    rng = random.Random(seed)
    words, fixed = [f"v{i}" for i in range(25)], ["the first of these passages stands often", "new york", "in the year of", "ha ha ha ha ha"]
    rows = []
    for i in range(n):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randrange(0, 60))]
        rows.append((i, "".join(p + rng.choice((" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", ": ")) for p in parts), rng.choice(("en", "fr", None))))
    return rows


def test_equals_plain_counts(sent):
    rows = corpus() + [(900 + i, "One copied line of TEXT, with Ünïcode wörds in it; new york", "en") for i in range(120)] + [(1, None, "en"), (2, "", None), (3, " ,. ", "de"), (4, "lone", "it")]
    want = plain(rows)
    assert want and got(sent, rows) == want
    assert got(sent, rows, top=7) == plain(rows, top=7) and got(sent, rows, parts=1, least=300) == plain(rows, least=300)


def test_flows_give_every_shorter_count(sent):
    rows = corpus(2)
    graph = Graph(sent.createDataFrame(rows, KIND), least=20)
    f, n = plain_counts(rows)
    names = {r["hash"]: (r["lang"], r["word"]) for r in graph.names.collect()}
    assert {r["lang"]: r["n"] for r in graph.totals.collect()} == dict(n)
    found = {}
    for r in graph.grams.collect():
        w = [names[r[f"w{i + 1}"]] for i in range(r["k"])]
        found[w[0][0], tuple(x for _, x in w)] = r["a"]
        assert r["f2"] == f[w[0][0], tuple(x for _, x in w[:2])] and (r["k"] < 4 or r["f3"] == f[w[0][0], tuple(x for _, x in w[:3])])
    assert found == {g: a for g, a in f.items() if len(g[1]) > 1 and a >= 20}
    single = {names[r["w1"]]: r["a"] for r in graph.words.collect() if r["w1"] in names}
    assert single and all(f[lang, (word,)] == a for (lang, word), a in single.items())


def test_unary_paths_are_whole_passages(sent):
    rows = [(i, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "en") for i in range(40)] + [(100 + i, "x alpha beta gamma delta epsilon", "en") for i in range(35)]
    found = {(r["a"], r["phrase"]) for r in passages(sent.createDataFrame(rows, KIND)).collect()}
    assert found == {(35, "x alpha beta gamma"), (75, "alpha beta gamma delta epsilon"), (40, "gamma delta epsilon zeta eta theta iota kappa")}


def test_long_text_large_counts_and_empty_tables(sent):
    rows = [(1, "a b c d " * 50_000, "en"), (2, "a b", "en")]
    assert got(sent, rows) == plain(rows)
    assert got(sent, []) == [] == got(sent, [(1, None, None)])
    more = sent.createDataFrame([(*r, 1, "x", "y") for r in corpus(3, 60)], f"{KIND}, rank int, phrase string, n string")
    assert sorted(map(tuple, collocations(more).collect())) == plain(corpus(3, 60))
