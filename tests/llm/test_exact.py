"""The operators against brute force, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.llm import ctw, langid, lmscore, neardup, packing, quality, tokencount, topk, wordbytes
from chorale.llm.components import connected_components

FOLDER = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
ODD = ["", " ", "a  b ", "foo<|endoftext|>bar <|endoftext|> x", "<|startoftext|>Hi<|endoftext|>", "ΣΑΣ İstanbul é é  x　y", "a\n\n b\t c\r\n", "don't I'll WE'RE 's '", "日本語 한국어 🙂🙂 ½ ²", "\x1c\x1dfoo!!\x1cbar", "a" * 3000, "!?" * 500, "x \n y", "tail ", "<|endoftext|", "e ́", "ẞ ß ﬁ", "12 345 ٣٤"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Tokens


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.sampled_from(ODD), st.text(max_size=60), st.text(alphabet="ab '’.\n\t<|endoftext|>é", max_size=60)))
def test_tokens_equal_the_libraries(text):
    from tokenizers import Tokenizer

    for name, count in (("word_bpe_49k.json", lambda: tokencount.merge_counter(tokencount.vocabulary_path("word_bpe_49k.json")).count(text)), ("byte_bpe_50k.json", lambda: packing.encoder(tokencount.vocabulary_path(packing.VOCABULARY)).ids(text))):
        own, ids = count(), _library(name, Tokenizer).encode(text, add_special_tokens=False).ids
        assert own == len(ids) if isinstance(own, int) else np.frombuffer(own, "<u4").tolist() == ids


_LIBRARIES: dict = {}


def _library(name, kind):
    if name not in _LIBRARIES:
        _LIBRARIES[name] = kind.from_file(tokencount.vocabulary_path(name))
    return _LIBRARIES[name]


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    library = _library("word_bpe_49k.json", Tokenizer)
    for r in tokencount.token_digest(docs).collect():
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def test_packing_is_an_exact_round_trip(docs, texts):
    from tokenizers import Tokenizer

    library = _library("byte_bpe_50k.json", Tokenizer)
    pieces, windows = {}, {}
    for r in packing.pack(docs, with_ids=True).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for doc, text in texts.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        own = sorted(pieces[doc], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == ids and {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
    fills = []
    for own in windows.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        fills.append(sum(r["length"] for r in own))
    assert max(fills) == 2048 and sum(f < 2048 for f in fills) <= docs.rdd.getNumPartitions()


def test_level_packer_chooses_the_least_sum_of_squares():
    random.seed(3)
    packer, window = packing.LevelPacker(64, None), 64
    for i in range(400):
        size = random.randint(1, 63)
        before = packer.level.copy()
        list(packer.place(i, b"\0\0\0\0" * size))
        squares = lambda level: int((level[1:window].astype(int) ** 2).sum())
        options = []
        for h in range(window - size + 1):
            if h and not before[h]:
                continue
            after = before.copy()
            after[h] -= bool(h)
            after[h + size] += h + size < window
            options.append(squares(after))
        assert squares(packer.level) == min(options)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=120), st.integers(1, 6))
def test_level_packer_keeps_few_windows_open(sizes, most):
    packer, seen, full, held = packing.LevelPacker(64, most), {}, 0, 0
    for i, size in enumerate(sizes):
        for window in packer.place(i, b"".join(k.to_bytes(4, "little") for k in range(size))):
            assert sum(len(p[2]) for p in window) == 4 * 64
            full += 1
            for doc, start, ids, n in window:
                seen.setdefault(doc, []).append((start, ids))
        held = sum(map(len, packer.open.values()))
        assert held == packer.count == packer.level.sum() <= most
    last = list(packer.finish())
    assert len(last) <= held and all(sum(len(p[2]) for p in w) == 4 * 64 for w in last[:-1])
    for window in last:
        for doc, start, ids, n in window:
            seen.setdefault(doc, []).append((start, ids))
    for i, size in enumerate(sizes):
        assert b"".join(ids for _, ids in sorted(seen[i])) == b"".join(k.to_bytes(4, "little") for k in range(size))


# Language models


def test_log_gamma():
    x = np.array([0.5, 1.0, 2.5, 17.0, 1e6 + 0.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def brute_ctw(train: list[bytes], text: bytes, depth: int) -> float:
    """The same model with dictionaries and recursion."""
    counts: dict = {}
    pad = b"\n" * depth
    for t in train:
        data = pad + t + b"\xff"
        for i in range(depth, len(data)):
            for k in range(8):
                for d in range(depth + 1):
                    counts.setdefault((data[i - d : i], (256 | data[i]) >> (8 - k)), [0, 0])[data[i] >> (7 - k) & 1] += 1
    children: dict = {}
    for c, p in counts:
        if c:
            children.setdefault((c[1:], p), []).append((c, p))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo: dict = {}

    def weighted(node):
        if node not in memo:
            own = kt(*counts[node])
            memo[node] = own if len(node[0]) == depth else math.log(0.5) + np.logaddexp(own, sum(map(weighted, children[node])))
        return memo[node]

    def predict(context, place, bit, d):
        node = (context[len(context) - d :] if d else b"", place)
        if node not in counts:
            return 0.5
        n = counts[node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return own
        w = math.exp(math.log(0.5) + kt(*n) - weighted(node))
        return w * own + (1 - w) * predict(context, place, bit, d + 1)

    data, total = pad + text + b"\xff", 0.0
    for i in range(depth, len(data)):
        for k in range(8):
            total += math.log10(predict(data[i - depth : i], (256 | data[i]) >> (8 - k), data[i] >> (7 - k) & 1, 0))
    return total


@pytest.mark.parametrize("depth, share, rows, size", [(2, lmscore.SHARE_ENTRIES, 8192, 1 << 25), (4, lmscore.SHARE_ENTRIES, 8192, 1 << 25), (3, 20, 3, 90)])
def test_scores_equal_brute_force(spark, monkeypatch, depth, share, rows, size):
    """In the last case, chunks end by rows and by bytes, and hot buckets are dealt over shares."""
    for name, value in (("SHARE_ENTRIES", share), ("CHUNK_ROWS", rows), ("CHUNK_BYTES", size)):
        monkeypatch.setattr(lmscore, name, value)
    words = "the cat sat on a mat ÄÖ Dog\nran".split(" ")
    random.seed(5)
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(40)] + [(40, None)]
    got = lmscore.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth=depth).collect()
    train = [lower(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len(got) == 41
    for r in got:
        assert math.isclose(r["score"], brute_ctw(train, lower(rows[r["doc_id"]][1] or "").encode(), depth), rel_tol=1e-5)


def test_probabilities_sum_to_one():
    data, _, _ = wordbytes.joined(["abracadabra alakazam"], b"\n" * 3, b"\xff")
    keys, counts = np.unique(ctw.grams(data, 3), return_counts=True)
    levels = ctw.subtree(keys, counts.astype(float), 3, 0)
    for context in (keys[5] >> np.uint64(8), np.uint64(0x7A7A7A)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert math.isclose(ctw.deep_probabilities(every, levels, 3).prod(axis=0).sum(), 1.0, rel_tol=1e-9)


def test_base_scores(docs, texts):
    tokens = lambda t: [*re.findall(SPACE, lower(t)), None]
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    total, distinct = sum(c.values()), len(c)
    for r in lmscore.score_documents(docs).collect():
        own = tokens(texts[r["doc_id"]])
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)


def test_language_accuracy_on_held_out(docs):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in langid.lang_digest(docs).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert rows and sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def brute_languages(rows):
    """(lang_pred, score) of each document, from plain counters over all labelled training documents."""
    lowered = {r["doc_id"]: (r["text"] or "").lower() for r in rows}
    words = {k: regex.findall(r"\p{L}+", t) for k, t in lowered.items()}
    train = [r for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    langs = [k for k, _ in sorted(Counter(r["lang"] for r in train).items(), key=lambda x: (-x[1], x[0]))]
    counts = {(n, k): Counter() for n in range(5) for k in langs}
    for r in train:
        for w in words[r["doc_id"]]:
            counts[0, r["lang"]][w] += 1
            for n in range(1, 5):
                counts[n, r["lang"]].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
    total = {key: sum(c.values()) for key, c in counts.items()}
    names = [set().union(*(counts[n, k] for k in langs)) for n in range(5)]
    floor = [0.5 / (max(total[n, k] for k in langs) + 0.5 * len(names[n]) + 1) for n in range(5)]
    gain = lambda n, g: np.array([np.log1p(counts[n, k][g] / total[n, k] / floor[n]) for k in langs])
    memo: dict = {}

    def score(word):
        if word in names[0]:
            return gain(0, word)
        for n in range(min(4, len(word) + 2), 0, -1):
            found = [gain(n, g) for i in range(len(word) + 3 - n) if (g := f" {word} "[i : i + n]) in names[n]]
            if found:
                return sum(found) / len(found)
        return np.zeros(len(langs))

    out = {}
    for k, own in words.items():
        for w in own:
            memo.setdefault(w, None)
            if memo[w] is None:
                memo[w] = score(w)
        sums = sum((memo[w] for w in own), np.zeros(len(langs)))
        out[k] = (langs[int(sums.argmax())], 1 / np.exp(np.maximum(sums - sums.max(), -700)).sum()) if own else ("und", 0.0)
    return out


def test_languages_equal_brute_force(docs):
    expected = brute_languages(docs.collect())
    got = {r["doc_id"]: r for r in langid.lang_digest(docs).collect()}
    assert len(got) == len(expected) and all(got[k]["lang_pred"] == lang and math.isclose(got[k]["score"], s, rel_tol=1e-3) for k, (lang, s) in expected.items())


# Quality


def test_quality_statistics(docs, texts):
    for r in quality.quality_digest(docs).collect():
        t = texts[r["doc_id"]]
        words = re.findall(SPACE, t)
        seen: dict = {}
        for i in range(len(words) - 4):
            seen.setdefault(tuple(words[i : i + 5]), []).append(i)
        covered = {j for v in seen.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(SPACE, x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[c] for c in quality.STATS[:5]) == expected
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def estimate(v: np.ndarray, c: np.ndarray):
    """The posteriors of the patterns and the model, in numpy."""
    q = np.choose(np.minimum((v == -1).sum(1), 2), [0.9, 0.5, 0.1])
    for _ in range(quality.ROUNDS + 1):
        weight = lambda x, vote, prior, bounds: np.clip((((c * x)[:, None] * (v == vote)).sum(0) + prior[0]) / (((c * x)[:, None] * (v != 0)).sum(0) + sum(prior)), *bounds)
        share = np.clip(((c * q).sum() + quality.SHARE_PRIOR[0]) / (c.sum() + sum(quality.SHARE_PRIOR)), *quality.SHARE_RANGE)
        good, bad = weight(q, 1, quality.GOOD_PRIOR, quality.GOOD_RANGE), weight(1 - q, -1, quality.BAD_PRIOR, quality.BAD_RANGE)
        odds = np.log(share / (1 - share)) + np.where(v == 1, np.log(good / (1 - bad)), np.where(v == -1, np.log((1 - good) / bad), 0)).sum(1)
        q = 1 / (1 + np.exp(-odds))
    return q, share, good, bad


def test_estimation_equals_numpy(spark):
    patterns = [([-1, 1, 1, 1, 1, 1, 1, 1, 1], 40.0), ([1] * 9, 900.0), ([-1, -1, 0, 1, 1, -1, 1, 0, -1], 60.0), ([0, 1, 1, 0, 1, 1, 0, 1, 0], 30.0)]
    df = spark.createDataFrame([(patterns,)], "p array<struct<v:array<int>,c:double>>")
    m = df.select(quality._estimate(df["p"]).alias("m")).select("m.*").first()
    _, share, good, bad = estimate(np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns]))
    assert math.isclose(m["share"], share, rel_tol=1e-9) and np.allclose(m["good"], good) and np.allclose(m["bad"], bad)


def brute_votes(t: str) -> list[int]:
    words, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
    n, chars, k = max(len(words), 1), max(sum(map(len, words)), 1), max(len(lines), 1)
    starts: dict = {}
    for i in range(len(words) - 4):
        starts.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = len({j for v in starts.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    odd = sum(bool(regex.search(r"""[^\p{L}\p{M}\p{N}'’.,;:!?()"«»“”„…¿¡–—-]""", w)) for w in words) / n
    ended = sum(bool(re.search(r"""[.!?:;…。]["'»”’)\]]?$""", x.rstrip(" \t\n\v\f\r"))) for x in lines)
    vote = lambda good, wrong, applies=True: (-1 if wrong else 1 if good else 0) if applies else 0
    symbols, upper, shouts = len(re.findall(r"[#*$%&|<>]", t)) / n, len(regex.findall(r"\p{Lu}", t)) / chars, t.count("!") / n
    variety, again, repeats, length = len(set(words)) / n, (len(lines) - len(set(lines))) / k, repeated / n, sum(map(len, words)) / n
    return [
        vote(symbols < 0.05, symbols > 0.1), vote(upper < 0.15, upper > 0.35, sum(map(len, words)) >= 20), vote(shouts < 0.1, shouts > 0.5), vote(variety > 0.5, variety < 0.3, len(words) >= 30),
        vote(again < 0.1, again > 0.3, len(lines) >= 4), vote(repeats < 0.05, repeats > 0.15, len(words) >= 10), vote(2 < length < 15, length < 1.2 or length > 40, len(words) >= 10),
        vote(odd < 0.1, odd > 0.2, len(words) >= 10), vote(ended / k > 0.8, ended / k < 0.5, len(words) >= 10),
    ]


def test_verdicts_equal_brute_force(docs, texts):
    votes = {i: tuple(brute_votes(t)) for i, t in texts.items()}
    counted = Counter(votes.values())
    patterns = sorted(counted)
    posterior = dict(zip(patterns, estimate(np.array(patterns), np.array([counted[p] for p in patterns], float))[0]))
    for r in quality.quality_digest(docs).collect():
        assert r["kept"] == (not r["base_failed"] and posterior[votes[r["doc_id"]]] >= quality.LEAST)


@pytest.mark.parametrize("noisy, good_share", [(0, 0.9), (3, 0.9), (0, 0.4)])
def test_noisy_rule_is_found_out(spark, noisy, good_share):
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < good_share
    wrong = np.where(np.arange(quality.RULES) == noisy, 0.05, 0.0005)
    v = np.where(rng.random((len(good), quality.RULES)) < np.where(good[:, None], wrong, 0.6), -1, 1)
    found, at = np.unique(v, axis=0, return_inverse=True)
    planted, all_ = np.bincount(at.ravel(), good), np.bincount(at.ravel())
    df = spark.createDataFrame([([(x.tolist(), float(c)) for x, c in zip(found, all_)],)], "p array<struct<v:array<int>,c:double>>")
    posteriors = df.select(quality._estimate(df["p"]).alias("m"), "p").select(F.transform("p", lambda p: quality.posterior(p["v"], F.col("m"))), "m.good", "m.share").first()
    kept = np.array(posteriors[0]) >= quality.LEAST
    assert planted[kept].sum() >= 0.99 * planted.sum() and (all_ - planted)[kept].sum() <= 0.05 * (all_ - planted).sum()
    assert abs(posteriors["good"][noisy] - 0.95) < 0.01 and abs(posteriors["share"] - good_share) < 0.02


def test_junk_goes_and_clean_stays(spark, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [r for r in quality.quality_digest(docs).collect() if r["doc_id"] in labels and not r["base_failed"]]
    assert all(r["kept"] for r in rows if labels[r["doc_id"]] == 1)
    assert sum(not r["kept"] for r in rows if labels[r["doc_id"]] == 0) >= 0.8 * sum(labels[r["doc_id"]] == 0 for r in rows)


# Near duplicates


def shingles(text):
    w = re.findall(SPACE, lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def test_components_equal_brute_force(docs, texts):
    expected = components(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.neardup_digest(docs).collect()} == expected


@pytest.mark.parametrize("block, crowd", [(neardup.BLOCK, neardup.CROWD_COUNT), (5, neardup.CROWD_COUNT), (5, 1)])
def test_components_of_chains_and_sizes(spark, monkeypatch, block, crowd):
    """Copies with one to many changed words around the threshold, in many sizes, and one large family."""
    for name, value in (("BLOCK", block), ("CROWD_COUNT", crowd), ("SAMPLE_SHARE", 1 / 16 if crowd > 1 else 1.0), ("ROW_CELLS", 2)):
        monkeypatch.setattr(neardup, name, value)
    random.seed(11)
    texts, n = {}, 0
    for size in [5, 6, 7, 9, 10, 13, 14, 20, 21, 33, 49, 50, 76, 120] + [60] * 3:
        base = [f"w{random.randrange(10**6)}" for _ in range(size)]
        for _ in range(4 if size != 60 else 60):
            copy = list(base)
            for _ in range(random.choice([0, 1, 1, 1, 2])):
                copy[random.choice([0, -1, random.randrange(len(copy))])] = f"x{random.randrange(10**6)}"
            texts[n] = " ".join(copy[: random.choice([None, None, -1])])
            n += 1
    expected = components(texts)
    got = neardup.neardup_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10**6))
def test_similar_sets_meet(common, left, right, seed):
    """Whatever the sets: if they are similar, the larger one probes a bucket that the other lists, or says it cannot."""
    rng = np.random.default_rng(seed)
    a, b, c = (rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in (common, left, right))
    one, two = np.unique(np.concatenate([a, b])), np.unique(np.concatenate([a, c]))
    if 100 * len(np.intersect1d(one, two)) < 80 * len(np.union1d(one, two)):
        return
    large, small = (one, two) if len(one) >= len(two) else (two, one)
    hot = np.unique(rng.choice(large, rng.integers(0, len(large) + 1)))
    names, probe, enough = neardup.entries(large, hot)
    assert not enough or np.isin(names[probe], neardup.entries(small, hot)[0]).any()


def test_sets_that_cannot_probe_are_joined_otherwise(spark, docs, texts, monkeypatch):
    own = docs.where("doc_id < 60")
    thin = neardup.describe_sets(own)
    short = thin.where("set_key IS NOT NULL").select("set_key").distinct()
    name = {r["doc_id"]: r["set_key"] for r in thin.collect()}
    got = {tuple(sorted(r)) for r in neardup._links_of_short(own, short).collect()}
    sets = {i: shingles(texts[i]) for i in range(60)}
    expected = {tuple(sorted((name[i], name[j]))) for i in sets for j in sets if i < j and name[i] != name[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert got == expected


@pytest.mark.parametrize("hub", [1000, 1])
def test_connected_components(spark, hub):
    random.seed(2)
    edges = [(i, i + 1) for i in range(60)] + [(100 + random.randrange(40), 100 + random.randrange(40)) for _ in range(30)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), least_hub=hub).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {x for x in root if all(x not in e or e[0] == e[1] for e in edges)}
    assert got == {k: v for k, v in root.items() if k not in alone}


def test_unsettled_components_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        connected_components(chain, rounds=2)
    assert {r["root"] for r in connected_components(chain).collect()} == {0}


# Search


def test_block_search_equals_brute_force():
    rng = np.random.default_rng(1)
    v = rng.integers(-90, 90, (700, 20)).astype(float)
    v[300:340] = v[5]
    ids = rng.permutation(700)
    got = topk.search_block(v[:30], ids[:30], ids[:30], v, ids, 5)
    for i in range(30):
        scores = v @ v[i]
        best = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        own = got[got["query_id"] == ids[i]]
        assert own["vec_id"].tolist() == ids[best].tolist() and own["score"].tolist() == scores[best].tolist()


def test_top_k_over_many_blocks(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    one, many = (sorted(tuple(r) for r in topk.top_k(df, every=3, block=b).collect()) for b in (4096, 37))
    assert one == many and len(one) > 100
