"""Each operator against a plain version on a small fixture, with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string"


def with_clashes(docs, *names):
    return docs.withColumns({n: F.lit("mine") for n in names})


# ---- decontamination

def plain_contamination(docs, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for name, text in items:
        words = split(text)
        if name is not None and words:
            for k in range(max(1, len(words) - width + 1)):
                windows.setdefault(tuple(words[k:k + width]), set()).add(str(name))
    out = []
    for doc, text in docs:
        words, hit, names = split(text), set(), set()
        for w in {len(x) for x in windows}:
            for s in range(len(words) - w + 1):
                found = windows.get(tuple(words[s:s + w]))
                if found:
                    hit |= set(range(s, s + w))
                    names |= found
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination(sent, prose):
    from vitalgrid.llm import decontaminate
    items = [(10, prose(1, 40)), (9, prose(1, 40)), (2, prose(2, 25)), (3, "Short ITEM, here!"), (4, None), (5, "..."), (None, prose(3, 20)), (6, "a " * 30), (7, prose(4, 9)), (7, prose(5, 12)), (8, "ünï çödé wörds")]
    words = prose(1, 40).split(" ")
    docs = [(1, prose(50, 300) + " " + prose(1, 40) + ". " + prose(51, 20)), (2, " ".join(words[5:14])), (3, " ".join(words[5:15])), (4, " ".join(words[5:20]) + "; " + prose(2, 25).upper()), (5, None), (6, ""), (7, "x Short item,here y"), (8, "a " * 9),
            (9, "a " * 10), (9, "a " * 10), (10, prose(3, 20)), (11, prose(4, 9) + " z " + prose(5, 12)), (12, "ÜNÏ ünï çödé wörds"), (13, prose(60, 20000) + " " + prose(2, 25)), (None, prose(2, 25)), (14, "!?")]
    table = with_clashes(sent.createDataFrame(docs, KIND), "row", "n_words", "items", "part").repartition(4)
    found = decontaminate.find_contamination(table, sent.createDataFrame(items, "item_id long, text string"))
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert got == plain_contamination(docs, items)
    assert found.where("part <> 'mine' OR row <> 'mine'").count() == 0
    none = decontaminate.find_contamination(table, sent.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs)
    assert decontaminate.find_contamination(sent.createDataFrame([], KIND), sent.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contamination_in_several_blocks(sent, prose, monkeypatch):
    from vitalgrid.llm import decontaminate
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    items = [(i, prose(i, 15 + i)) for i in range(12)]
    docs = [(i, prose(i % 12, 15 + i % 12) + " and " + prose(99 + i, 30) + " " + prose((i + 5) % 12, 12)) for i in range(30)]
    found = decontaminate.find_contamination(sent.createDataFrame(docs, KIND), sent.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in found.drop("text", "items").collect()), key=str) == plain_contamination(docs, items)


# ---- tokens and packing

def test_chunk_ids_are_the_tokenizers(prose):
    from vitalgrid.llm.tokens import encoder
    e = encoder(None)
    texts = [prose(1, 50), "It's WE'LL don't! a1b22 x_y -- ...", "Éé ñandú İstanbul ΑΣ ς 中文 ﬁ ½² ªº", "a\x1cb\x85c\xa0d　e", "<|endoftext|> x<|endoftext|>y <|", "", " \n", "é ́x", "x" * 3000, "😀😀 né́e"]
    for text in texts:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_close_to_the_bound(sent, prose):
    from vitalgrid.llm.packing import pack
    from vitalgrid.llm.tokens import encoder
    docs = [(i, prose(i, 3 + (i * 37) % 400)) for i in range(300)] + [(1000, prose(5, 6000)), (1001, None), (1002, ""), (1003, prose(6, 10)), (1003, prose(6, 10)), (None, prose(7, 20))]
    table = with_clashes(sent.createDataFrame(docs, KIND), "length", "offset").repartition(3)
    rows = pack(table).collect()
    e, want = encoder(None), Counter()
    for name, text in docs:
        ids = np.frombuffer(e.encode(text or ""), "<u4").tolist() + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[name, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(by) <= math.ceil(total / 4096) * 1.03 + 3
    assert pack(sent.createDataFrame([], KIND)).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    from vitalgrid.llm.packing import BestFit
    bins = BestFit(10, 2, 0)
    assert bins.place(7) == (0, 0) and bins.place(6) == (1, 0) and bins.place(3) == (0, 7)
    assert bins.place(5) == (2, 0) and bins.place(8) == (3, 0)  # bin 1 (4 free) was fuller than bin 2 and is closed
    assert bins.place(4) == (2, 5) and bins.place(10) == (4, 0) and bins.n_open == 2


# ---- language

def test_language(sent):
    from vitalgrid.llm.language import Profiles, identify, ranked
    rows = [(i, "den und die der schöne haus baum " * (2 + i % 3), "de") for i in range(30)] + [(100 + i, "the of and house tree with this " * (2 + i % 4), "en") for i in range(30)]
    rows += [(200, None, "en"), (201, "12 34 !", "de"), (202, "", None), (203, "the of and this", None), (204, "der Baum und DAS haus", "en"), (204, "der Baum und DAS haus", "en"), (None, "with this house", None), (205, "中文字", None), (206, "of the and " * 30000, None)]
    docs = with_clashes(sent.createDataFrame(rows, KIND + ", lang string"), "score")
    got = {r["doc_id"]: r for r in identify(docs, F.col("doc_id") >= 200).collect()}
    assert all(got[i]["lang_pred"] == "de" and got[100 + i]["lang_pred"] == "en" for i in range(30))
    assert [got[i]["lang_pred"] for i in (200, 201, 202, 203, 204, 206, None)] == ["und", "und", "und", "en", "de", "en", "en"]
    assert got[205]["lang_pred"] in ("de", "en") and all(0 <= r["score"] <= 1 for r in got.values()) and got[200]["held_out"] and not got[5]["held_out"]
    assert {r["lang_pred"] for r in identify(docs, F.lit(True)).collect()} == {"und"}
    assert identify(docs.where("false"), F.col("doc_id") >= 200).count() == 0
    # equal counts rank by code; the distance is out of place
    assert ranked(np.array([5, 3, 3, 9, 9, 1], np.int32), 3).tolist() == [3, 9, 1]
    p = Profiles({"a": np.array([1, 2, 3]), "b": np.array([3, 2, 9])}, 3)
    assert p.nearest(np.array([1, 2, 3])) == ("a", 1.0) and p.nearest(np.array([3, 2])) == ("b", 1.0) and p.nearest(np.array([7])) == ("a", 0.0)


# ---- toxicity

def test_nearest_examples_are_those_of_a_full_scan():
    from vitalgrid.llm.toxicity import Index
    rng = np.random.default_rng(3)
    n, v = 500, 40
    vectors = rng.random((n, v)) * (rng.random((n, v)) < 0.1)
    vectors[200:230] = vectors[5]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    ids = rng.permutation(n)
    index = Index(np.arange(v, dtype=np.uint64), rng.random(v) + 1, ids, (rng.random(n) < 0.5).astype(float), np.ones(n), vectors)
    for _ in range(60):
        terms, weight = index.query(rng.integers(0, v, rng.integers(1, 12)))
        scores = vectors[:, terms] @ weight
        best = np.lexsort((ids, -np.round(scores, 12)))[:15]
        best = best[scores[best] > 0]
        rows, cosines = index.nearest(terms, weight, 15)
        assert np.allclose(cosines, scores[best]) and set(np.round(scores[rows], 9)) == set(np.round(scores[best], 9))


def test_toxicity(sent, prose):
    from vitalgrid.llm.toxicity import score_toxicity
    bad = ["vile", "scum", "trash"]
    rows = [(i, prose(i, 40) + (f" {bad[i % 3]} {bad[i % 2]}" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (902, "Vile SCUM! " + prose(7, 9000)), (903, prose(8, 30)), (903, prose(8, 30)), (None, "trash vile")]
    labels = [(i, int(i % 4 == 0)) for i in range(300)] + [(300, None), (301, 7), (None, 1), (5, 0)]
    docs = with_clashes(sent.createDataFrame(rows, KIND), "score", "row").repartition(3)
    got = score_toxicity(docs, sent.createDataFrame(labels, "doc_id long, toxic int"))
    by = {r["doc_id"]: r for r in got.collect()}
    assert all(by[i]["predicted"] == int(i % 4 == 0) and 0 <= by[i]["score"] <= 1 for i in range(400))
    assert by[902]["predicted"] == 1 and by[None]["predicted"] == 1 and by[903]["predicted"] == by[900]["predicted"] == by[901]["predicted"] == 0
    assert all(x["cosine"] > 0 for x in by[902]["neighbours"]) and len(by[902]["neighbours"]) == 15 and got.count() == len(rows)
    none = score_toxicity(docs, sent.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("score")).first()[0] == 0 and none.count() == len(rows)
    assert score_toxicity(docs.where("false"), sent.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def plain_toxicity(docs, labels, k=15):
    """Terms, vectors, neighbours, leave-one-out votes and curve over all examples; ids are unique."""
    bags = {d: Counter(re.findall(r"[a-z0-9]+", t.translate(AZ))) for d, t in docs}
    n = [sum(y == v for v in labels.values()) for y in (0, 1)]
    held = [Counter(w for d, v in labels.items() if v == y for w in bags[d]) for y in (0, 1)]
    terms = []
    for w in held[1]:
        c = [held[0][w], held[1][w]]
        cells = [(seen, there, n[y]) for y in (0, 1) for seen, there in ((c[y], sum(c)), (n[y] - c[y], sum(n) - sum(c)))]
        gain = sum(2 * seen * math.log(seen * sum(n) / (there * total)) for seen, there, total in cells if seen)
        if sum(c) >= 3 and c[1] * n[0] >= 3 * c[0] * n[1] and gain >= 10.83:
            terms.append(w)
    place = {w: i for i, w in enumerate(terms)}
    df = Counter(w for b in bags.values() for w in b)
    vectors = np.zeros((len(docs), len(terms)))
    for i, (d, _) in enumerate(docs):
        for w in bags[d].keys() & place.keys():
            vectors[i, place[w]] = (1 + math.log(bags[d][w])) * (math.log((1 + len(docs)) / (1 + df[w])) + 1)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    ids = np.array([d for d, _ in docs])
    rows = np.array([i for i, d in enumerate(ids.tolist()) if d in labels])
    marks = np.array([labels[d] for d in ids[rows].tolist()], float)

    def nearest(cosines, leave):
        at = np.flatnonzero((cosines > 0) & (ids[rows] != leave))
        best = at[np.lexsort((ids[rows][at], -np.round(cosines[at], 12)))[:k]]
        return best, cosines[best]

    def vote(best, cosines):
        weight = 1 / (0.05 + np.maximum(0, 1 - cosines))
        return float(np.sum(weight * marks[best]) / np.sum(weight))

    near, votes, alone = {}, [], []
    examples = vectors[rows].T
    for i, d in enumerate(ids.tolist()):
        if i % 500 == 0:
            block = vectors[i:i + 500] @ examples
        cosines = block[i % 500]
        near[d] = nearest(cosines, None)
        if d in labels:
            other = nearest(cosines, d)
            if len(other[0]):
                votes.append((vote(*other), labels[d]))
            else:
                alone.append(labels[d])
    pools = []
    for v, y in sorted(votes):
        pools.append([1, y, v])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + z for x, z in zip(pools[-1], last, strict=True)]
    curve = [p[2] / p[0] for p in pools], [p[1] / p[0] for p in pools]
    score = {d: float(np.interp(vote(*x), *curve)) if len(x[0]) else float(np.mean(alone)) for d, x in near.items()}
    return terms, {d: (ids[rows][x[0]].tolist(), x[1]) for d, x in near.items()}, score


def test_toxicity_learns_from_all_examples_and_all_terms(sent, monkeypatch):
    """More examples of a label and more terms than were once taken, in several shards, with crowds of one bag."""
    from vitalgrid.llm import toxicity
    monkeypatch.setattr(toxicity, "SHARD", 1500)
    monkeypatch.setattr(toxicity, "CHUNK", 2000)
    rng = np.random.default_rng(11)
    docs, labels = [], {}
    for i in range(8600):
        bad = i % 2 == 0
        words = [f"m{x}" for x in rng.integers(0, 1200, 5)] if bad else [f"m{rng.integers(0, 1200)}"] if i % 15 == 0 else []
        words = [f"m{x}" for x in (1, 2, 3)] * (1 + i % 3) if i % 70 == 0 else words * int(rng.integers(1, 3)) + words[:2]
        docs.append((i, " ".join([*words, *(f"w{x}" for x in rng.integers(0, 500, 5))])))
        if i < 8500:
            labels[i] = int(bad != (i % 97 == 0))
    terms, near, score = plain_toxicity(docs, labels)
    assert sum(labels.values()) > 4096 and len(terms) > 1024
    found = toxicity.score_toxicity(sent.createDataFrame(docs, KIND).repartition(4), sent.createDataFrame([*labels.items()], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in found.select("doc_id", "score", "predicted", "neighbours").collect()}
    assert len(got) == len(docs) and sum(len(x[0]) > 0 for x in near.values()) > 4096
    for d, (ids, cosines) in near.items():
        row = got[d]
        assert len(row["neighbours"]) == len(ids) and np.allclose([x["cosine"] for x in row["neighbours"]], cosines)
        assert all(x["label"] == labels[x["doc_id"]] for x in row["neighbours"])
        assert abs(row["score"] - score[d]) < 1e-6 and row["predicted"] == int(row["score"] >= 0.5)
    same = sum([x["doc_id"] for x in got[d]["neighbours"]] == ids for d, (ids, _) in near.items())
    assert same > 0.99 * len(docs)  # cosines may be equal but for rounding


def test_pools_of_ranges_are_those_of_all_votes():
    from vitalgrid.llm.toxicity import pooled
    rng = np.random.default_rng(5)
    votes = sorted((float(v), int(rng.random() < v)) for v in np.round(rng.random(3000), 2))
    one = lambda rows: pooled([v, v, 1.0, float(y), v] for v, y in rows)
    parts = [one([x for x in votes if int(5 * x[0]) == a]) for a in range(6)]
    whole, merged = one(votes), pooled(p for part in parts for p in part)
    assert np.allclose(whole, merged) and all(a[3] / a[2] < b[3] / b[2] for a, b in zip(whole, whole[1:], strict=False))


# ---- secrets

def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def test_secrets(sent, prose):
    from vitalgrid.llm.secret_scan import find_secrets, redacted
    rng = np.random.default_rng(4)
    random = lambda n, signs: "".join(rng.choice(list(signs), n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = [random(40, letters) for _ in range(12)]
    texts = ["", None, prose(1, 60), 'é😀 Password = "abc123" token:abc', "token=token: abcdefgh secret=é", "api_key='x' API-KEY: abcdefg apikey:abcdefg", "AKIA" + "A1" * 8 + " AKIA123 xAKIAAKIA" + "Z" * 20, "0" * 23 + " " + "ab12" * 6 + " " + "0123456789abcdef" * 3,
             "secret: " + "deadbeef" * 4, "token=" + "a" * 200_000, "password=hunter22" * 300, "the-quick-brown-fox-jumps-over-the-lazy-dog/and/then/some/more/words"]
    texts += [prose(20 + i, 10) + " " + k + " end" for i, k in enumerate(keys)] + [prose(70 + i, 5) + " " + prose(90 + i, 6).replace(" ", "") for i in range(30)]
    rows = list(enumerate(texts)) + [(0, texts[8]), (None, texts[8])]
    docs = with_clashes(sent.createDataFrame(rows, KIND), "spans", "base", "body").withColumn("n_chars", F.length("text")).repartition(3)
    got = find_secrets(docs)
    for r in got.where("doc_id > 0").collect():
        text = texts[r["doc_id"]] or ""
        base = plain_spans(text)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in base) for i in range(3)]
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert len(spans) == sum(r[f"n_{k}"] for k in ("assign", "access", "hex", "random"))
    by = {r["doc_id"]: r for r in got.collect()}
    first = len(texts) - 42
    assert sum(by[first + i]["n_random"] for i in range(12)) >= 11  # a random string fails a 1 % test now and then
    assert sum(by[i]["n_random"] for i in range(first + 12, len(texts))) == 0 and by[2]["n_random"] == by[11]["n_random"] == 0
    clean = {r["doc_id"]: r for r in redacted(docs).where("doc_id IS NOT NULL AND doc_id > 0").collect()}
    assert clean[2]["text"] == texts[2] and clean[1]["text"] is None and clean[8]["text"] == "[SECRET]" and clean[3]["text"].startswith("é😀 [SECRET]")
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values() if r["text"] is not None) and redacted(docs).columns == docs.columns
    assert find_secrets(sent.createDataFrame([], KIND)).count() == 0


def test_best_random_strings_of_a_band_with_many_ordinary_ones_are_found(sent, prose):
    from vitalgrid.llm.secret_scan import ALPHA, ENCODINGS, FALSE_SHARE, find_secrets, passing_chance
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list(ENCODINGS[5][1]), 27)) for _ in range(40)]
    plain = [prose(300 + i, 12).title().replace(" ", "")[:26] + "7" for i in range(160)]
    chance = passing_chance(5, 24, ALPHA)
    assert 140 * chance / (1 - chance) > FALSE_SHARE * len(keys)  # the band as a whole has too many ordinary strings
    rows = list(enumerate([f"{prose(i, 5)} {x} end" for i, x in enumerate(keys + plain)]))
    n = {r["doc_id"]: r["n_random"] for r in find_secrets(sent.createDataFrame(rows, KIND)).collect()}
    found, false = sum(n[i] for i in range(40)), sum(n[i] for i in range(40, 200))
    assert found >= 12 and false <= 2, (found, false)


# ---- resampling

def test_resampling(sent, prose):
    from vitalgrid.llm.resampling import resample, top_rows
    rows = [(i, prose(i % 9, 50) if i % 3 else " ".join(f"junk{(i * 7 + k) % 50}" for k in range(60))) for i in range(240)] + [(900, None), (901, ""), (902, prose(3, 8000)), (7, prose(7, 50)), (None, prose(1, 10))]
    docs = with_clashes(sent.createDataFrame(rows, KIND), "selected", "noise")
    good = sent.createDataFrame([(i,) for i in range(240) if i % 3 and i % 2] + [(None,), (1,), (5000,)], "doc_id long")
    got = resample(docs, good)
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) and sum(r["selected"] for r in got.collect()) == len(rows) // 2
    assert min(by[i]["log_weight"] / by[i]["n_grams"] for i in range(240) if i % 3) > max(by[i]["log_weight"] / by[i]["n_grams"] for i in range(240) if not i % 3)
    assert by[900]["log_weight"] == by[901]["log_weight"] == 0 and by[902]["n_grams"] == 15999
    assert {r["doc_id"]: r["sample_key"] for r in resample(docs.repartition(7), good).collect()}[902] == pytest.approx(by[902]["sample_key"])
    assert resample(docs, good.where("false")).agg(F.max("log_weight")).first()[0] == 0
    assert resample(docs.where("false"), good).count() == 0
    keys = sent.createDataFrame([(i, float(i // 5)) for i in range(1000)], "id long, k double")
    assert sorted(r["id"] for r in top_rows(keys, "k", ["id"], 13)[1].where("selected").collect()) == [985, 986, 987, *range(990, 1000)]


# ---- separators

@pytest.mark.parametrize("width,sizes", [(2, [4096]), (2, [7]), (4, [1, 3, 64]), (1, [5]), (2, [2])])
def test_token_counts_in_streams(sent, width, sizes):
    from vitalgrid.llm.separators import count_tokens
    rng = np.random.default_rng(width)
    want, blocks = [], []
    for stream in range(5):
        lengths = [[], [0, 0, 3], rng.integers(0, 40, 60).tolist(), [2000], rng.integers(0, 9, 300).tolist()][stream]
        tokens = [t for n in lengths for t in [*rng.integers(1, 250, n), 255]]
        want += [(stream, i, int(n), True) for i, n in enumerate(lengths)]
        if stream % 2:
            tokens += [7, 7, 7]
            want.append((stream, len(lengths), 3, False))
        data, at, number = np.array(tokens, f"<u{width}").tobytes(), 0, 0
        while at < len(data):
            size = sizes[number % len(sizes)]
            blocks.append((stream, number, bytearray(data[at:at + size])))
            at, number = at + size, number + 1
    table = sent.createDataFrame(blocks, "stream int, block long, data binary").repartition(4)
    assert sorted(tuple(r) for r in count_tokens(table, 255, width).collect()) == sorted(want)
    assert count_tokens(table.where("false"), 255, width).count() == 0


def test_documents_as_streams_and_files(sent, prose, tmp_path):
    from vitalgrid.llm.separators import count_tokens, read_streams, token_streams
    from vitalgrid.llm.tokens import encoder
    docs = [(i, prose(i, 1 + i * 3)) for i in range(60)] + [(100, None), (101, ""), (102, prose(9, 5000)), (102, prose(9, 5000)), (None, "one")]
    blocks, order = token_streams(sent.createDataFrame(docs, KIND).repartition(3), 49407, block_bytes=512)
    counts = count_tokens(blocks, 49407, aligned=True).join(order, ["stream", "place"])
    e = encoder(None)
    assert Counter((r["id"], r["n_tokens"]) for r in counts.collect()) == Counter((i, len(e.encode(t or "")) // 4) for i, t in docs)
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 9, 3, 9, 4], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    got = count_tokens(read_streams(sent, str(tmp_path), 3), 9)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(0, 2, True), (1, 0, True), (2, 1, True), (3, 1, False)]


def test_texts_with_the_tokenizers_own_end_mark_stay_whole(sent, prose, tmp_path):
    from vitalgrid.llm.queries import op7_token_counts
    from vitalgrid.llm.separators import token_streams
    from vitalgrid.llm.tokens import encoder
    docs = [(0, prose(1, 5)), (1, f"{prose(2, 4)} <|endoftext|> {prose(3, 6)}"), (2, prose(4, 9)), (3, "<|endoftext|>"), (4, prose(5, 2))]
    table = sent.createDataFrame(docs, KIND).coalesce(1)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    e = encoder(None)
    assert 49407 in np.frombuffer(e.encode(docs[1][1]), "<u4")
    assert {r["doc_id"]: r["n_tokens"] for r in op7_token_counts(sent, str(tmp_path)).collect()} == {i: len(e.encode(t)) // 4 for i, t in docs}
    with pytest.raises(Exception, match="end identifier 49407"):
        token_streams(table, 49407)


def test_large_token_files_are_read_in_parts(sent, tmp_path):
    from vitalgrid.llm.separators import count_tokens, read_streams
    rng = np.random.default_rng(5)
    want, sizes = set(), {"many divisors.bin": 5040, "tail.bin": 2 * 4999, "a,b [1] {x}.bin": 3 * 1681, "small.bin": 40, "empty.bin": 0}
    for name, n in sizes.items():
        tokens = np.where(rng.random(n) < 0.05, 9, 1 + rng.integers(0, 8, n)).astype("<u2")
        (tmp_path / name).write_bytes(tokens.tobytes())
        at = np.flatnonzero(tokens == 9)
        lengths = [*(np.diff(at, prepend=-1) - 1).tolist(), *([n - 1 - int(at[-1])] if n and at[-1] < n - 1 else [])]
        want |= {(name, i, k, i < len(at)) for i, k in enumerate(lengths)}
    blocks = read_streams(sent, str(tmp_path), 101, part_bytes=1500)
    assert {r["stream"].rsplit("/", 1)[1] for r in blocks.collect()} == {n for n, size in sizes.items() if size}
    assert blocks.where("stream LIKE '%tail.bin'").rdd.glom().filter(len).count() > 5
    got = [tuple(r) for r in count_tokens(blocks, 9).collect()]
    tiny = [("t", i, bytearray([b])) for i, b in enumerate(np.array([5, 9, 9, 7, 6], "<u4").tobytes())]
    few = sent.createDataFrame(tiny, "stream string, block long, data binary")
    assert sorted(tuple(r)[1:] for r in count_tokens(few, 9, 4).collect()) == [(0, 1, True), (1, 0, True), (2, 2, False)]
    with pytest.raises(Exception, match="do not fill an identifier"):
        count_tokens(few.where("block < 19"), 9, 4)
    assert {(s.rsplit("/", 1)[1], *x) for s, *x in got} == want and len(got) == len(want)


# ---- hidden Markov model

def test_forward_is_the_sum_over_all_paths():
    from itertools import product

    from vitalgrid.llm import hidden_markov as H
    rng = np.random.default_rng(1)
    chain = H.Chain(rng.random(H.STATES), rng.random((H.STATES, H.STATES)), rng.random((H.STATES, H.CLASSES)))
    texts = [[3], [1, 2], [5, 1, 7, 9], []]
    classes, first = np.array([c for t in texts for c in t]), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    want = []
    for t in texts:
        total = sum(np.prod([chain.start[p[0]], *(chain.move[a, b] for a, b in zip(p, p[1:], strict=False)), *(chain.emit[s, c] for s, c in zip(p, t, strict=True))]) for p in product(range(H.STATES), repeat=len(t))) if t else 1.0
        want.append(math.log10(total))
    assert np.allclose(chain.log10(classes, first), want)


def test_baum_welch_counts_add_up_and_raise_the_likelihood(monkeypatch):
    from vitalgrid.llm import hidden_markov as H
    rng = np.random.default_rng(2)
    texts = [np.concatenate([rng.integers(1 + 20 * s, 15 + 20 * s, rng.integers(3, 200)) for s in rng.permutation(4)[:2]]) for _ in range(40)]
    classes, first = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    chain = H.Chain(rng.random(H.STATES) + 1, rng.random((H.STATES, H.STATES)) + 1, rng.random((H.STATES, H.CLASSES)) + 1)
    last = -np.inf
    monkeypatch.setattr(H, "SEGMENT", 1000)  # whole texts: then every round must gain
    for _ in range(5):
        now = chain.log10(classes, first).sum()
        assert now >= last - 1e-9
        last = now
        start, move, emit = chain.expected(classes, first)
        assert start.sum() == pytest.approx(len(texts)) and emit.sum() == pytest.approx(len(classes)) and move.sum() == pytest.approx(len(classes) - len(texts))
        parts = [chain.expected(classes[first[a]:first[b]], first[a:b + 1] - first[a]) for a, b in ((0, 13), (13, 40))]
        assert np.allclose(parts[0][2] + parts[1][2], emit) and np.allclose(parts[0][1] + parts[1][1], move)
        chain = H.Chain(start + 1e-9, move + 1e-9, emit + 1e-9)


def test_language_model_scores(sent, prose):
    from vitalgrid.llm.hidden_markov import score_texts
    rows = [(i, prose(i, 30) if i % 2 else " ".join(f"w{(i + k) % 9}" for k in range(40))) for i in range(120)] + [(500, None), (501, ""), (502, prose(3, 20000)), (503, "Same same"), (503, "Same same"), (None, prose(4, 5)), (504, "never seen words")]
    docs = with_clashes(sent.createDataFrame(rows, KIND), "key", "learn", "score").repartition(4)
    held = F.coalesce(F.col("doc_id") % 5 == 1, F.lit(False)) | F.coalesce(F.col("doc_id") == 504, F.lit(False))
    got = score_texts(docs, held).collect()
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ)), None], i is not None and (i % 5 == 1 or i == 504)) for i, t in rows]
    c = Counter(w for _, own, out in words if not out for w in own)
    n, v = sum(c.values()), len(c)
    want = Counter((i, out, len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)) for i, own, out in words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    tested = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in tested) > sum(r["base_score"] for r in tested)
    nothing = score_texts(docs, F.lit(True)).collect()
    assert len(nothing) == len(rows) and {r["train_tokens"] for r in nothing} == {0} and all(r["n_known"] == 0 for r in nothing)
    assert score_texts(docs.where("false"), held).count() == 0


def test_look_ahead_does_not_follow_the_batches():
    import pyarrow as pa

    from vitalgrid.llm.packing import _looked_ahead
    rows = list(range(57))
    for cut in (1, 7, 57):
        batches = [pa.record_batch([pa.array(rows[i:i + cut])], ["x"]) for i in range(0, len(rows), cut)]
        out = [b.column(0).to_pylist() for b in _looked_ahead(iter(batches), 10)]
        assert [len(x) for x in out] == [10] * 5 + [7] and sum(out, []) == rows
    assert list(_looked_ahead(iter([]), 10)) == []
