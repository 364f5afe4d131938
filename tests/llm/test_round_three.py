"""Spelling variants, conversation repair and SentencePiece ids against brute force and the library."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chorale.llm import convrepair, pieces, spelling
from chorale.llm.tokencount import vocabulary_path

# Spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts: dict[str, int], ratio: int = 5) -> dict:
    near = {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: best[w] if best[w] is not None and counts[best[w]] >= ratio * counts[w] else None for w in counts}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def test_variants_equal_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdeéÿß", k=rng.randrange(3, 12))) for _ in range(25)]
    counts = {}
    for stem in stems:
        for _ in range(25):
            w = list(stem)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choices("abcdeéÿß", k=rng.randrange(2))
            if w:
                counts["".join(w)] = rng.choice([1, 2, 5, 10, 25, 50, 125, 626])
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == brute_variants(counts) and any(x[0] for x in got.values())


def test_roots_follow_long_chains(spark):
    chain = [("a" * (6 + i), 5**i) for i in range(14)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert all(got[w]["root"] == chain[-1][0] for w, _ in chain) and got[chain[0][0]]["form"] == chain[1][0] and got[chain[-1][0]]["form"] is None
    with pytest.raises(ValueError, match="more frequent"):
        spelling.variants(spark.createDataFrame(chain, "word string, n long"), ratio=1)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcxyzàéÿ÷", min_size=1, max_size=12), st.integers(0, 11), st.sampled_from("abzéÿ"), st.sampled_from("idr"))
def test_one_edit_leaves_a_band(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + (letter + word[at:] if kind == "i" else letter + word[at + 1 :] if kind == "r" else word[at + 1 :])

    def bands(w):
        places = [ord(c) - 97 if c < "\x80" else ord(c) - 0xC0 + 26 for c in w]
        return [sum(1 << p // 3 for p, n in Counter(places).items() if p % 3 == b and n % 2) for b in range(3)]

    assert any(x == y for x, y in zip(bands(word), bands(other)))


def test_masks_are_letter_parities(spark):
    words = ["banana", "éàéÿ", "zzz", "÷a×"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(spelling.masks(F.col("w"))).collect()]
    for w, mask in zip(words, got):
        places = Counter(ord(c) - 97 if c < "\x80" else ord(c) - 0xC0 + 26 for c in w)
        assert mask == [sum(1 << p // 3 for p, n in places.items() if p % 3 == b and n % 2) for b in range(3)]


def test_words_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "ÀBCDÉF abcdef1abcdef ab" + "c" * 5000), (None, "Straße straße STRASSE"), (5, "x" * 199), (5, "x" * 199)]
    rows += [(i, " ".join(f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300))) for i in range(10, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("kept")).withColumn("N", F.lit(1))
    expected: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            expected[run[:k] + run[k + 1 :] if h % 199 == 0 else run] += 1
    assert {r["word"]: r["n"] for r in spelling.damaged_words(docs).collect()} == dict(expected) and "Àbcd" + "Éf" in expected
    counts = {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variant_digest(docs).collect()}
    assert got == brute_variants(counts) and got
    assert spelling.variant_digest(docs.where("false")).count() == 0


# Conversations

TURNS = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    """The first fault of each row, in order."""
    seen, out = set(), []
    for role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The least (cost, audit) and its text, of all ways to edit the rows with one insertion at most between two of them."""
    faults = faults_of(rows)
    between = [[], [("I", "user", "", 5)], [("I", "assistant", "", 5)], [("I", "user", "", 5), ("I", "assistant", "", 5)], [("I", "assistant", "", 5), ("I", "user", "", 5)]]
    ways = []
    for (role, text), fault in zip(rows, faults):
        cut = 5 * (fault == "truncated")
        stay = [] if fault in ("blank", "duplicate") else [[("K", role, text, cut)], [("R", "user", text, 1 + cut)], [("R", "assistant", text, 1 + cut)]]
        ways += [between, [[("D", None, None, 2)], *stay]]
    best = None
    for way in itertools.product(*ways, between):
        steps = [s for part in way for s in part]
        left = [(role, text) for letter, role, text, _ in steps if letter != "D"]
        if re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in left)) and all(role for role, _ in left):
            found = (sum(s[3] for s in steps), "".join(s[0] for s in steps), "\n".join(f"{r}:{t}" for r, t in left))
            best = min(best or found, found)
    return best


def random_rows(rng, many):
    return [(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", " ", "sys", "u"]), rng.choice(["Hi.", "Yes!", "no end", "", " \n", "What?", "a. ", "x.\x0b"])) for _ in range(many)]


def test_repair_equals_brute_force(spark):
    rng = random.Random(3)
    conversations = {i: random_rows(rng, rng.randrange(4)) for i in range(60)}
    rows = [(i, t, *row) for i, own in conversations.items() for t, row in enumerate(own)]
    turns = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in convrepair.audit(turns).collect()}
    written = defaultdict(list)
    for r in convrepair.edits(turns).orderBy("conv_id", "step").collect():
        written[r["conv_id"]].append(r)
    assert set(got) == {r[0] for r in rows}
    for i, r in got.items():
        cost, audit, text = brute_repair(conversations[i])
        faults = faults_of(conversations[i])
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(conversations[i], conversations[i][1:])]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, sha256(text.encode()).hexdigest())
        assert (r["blank"], r["duplicate"], r["truncated"]) == tuple(map(faults.count, ("blank", "duplicate", "truncated"))) and r["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        assert "".join(e["edit"] for e in written[i]) == audit and "\n".join(f"{e['role']}:{e['text']}" for e in written[i] if e["edit"] != "D") == text
        assert [e["fault"] for e in written[i] if e["edit"] != "I"] == faults and [e["step"] for e in written[i]] == list(range(len(audit)))


def test_insertions_are_traced(monkeypatch):
    """Where deleting is dear, rows are inserted; blocks of a long conversation give the same edits as one tensor."""
    monkeypatch.setattr(convrepair, "DELETE", 20)
    rng = np.random.default_rng(2)
    sizes = np.array([0, 1, 2, 7, 40, 300, 3])
    codes = rng.integers(0, 4, sizes.sum()) + 8 * rng.integers(0, 2, sizes.sum()) + 4 * (rng.random(sizes.sum()) < 0.1)
    whole = convrepair.solve(codes, sizes)
    assert (whole[3] == ord("I")).any()
    monkeypatch.setattr(convrepair, "BLOCK", 5)
    for a, b in zip(whole, convrepair.solve(codes, sizes)):
        assert np.array_equal(a, b)
    for conv, size in enumerate(sizes):
        rows = whole[2][(whole[1] == conv) & (whole[2] >= 0)]
        assert np.array_equal(np.sort(rows), rows) and len(rows) == size


def test_long_conversations_are_spooled(spark, monkeypatch):
    rng = random.Random(9)
    long = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", "", "!"])) for t in range(900)]
    rows = [(c, t, "user", f"{c} {t}.") for c in (1, 2, 9) for t in range(3)] + long
    turns = spark.createDataFrame(rows, TURNS)
    batches = convrepair._marked(turns).coalesce(1).sortWithinPartitions("conv_id", "turn").toArrow().to_batches(max_chunksize=70)
    plain = [r for b in convrepair._audit_rows(iter(batches)) for r in b.to_pylist()]
    monkeypatch.setattr(convrepair, "HELD", 500)
    assert [r for b in convrepair._audit_rows(iter(batches)) for r in b.to_pylist()] == plain and len(plain) == 4
    edits = [r for b in convrepair._edit_rows(iter(batches)) for r in b.to_pylist() if r["conv_id"] == 7]
    assert "".join(r["edit"] for r in edits) == next(r["audit"] for r in plain if r["conv_id"] == 7)


def test_conversations_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 9, "", "c."), (2, 3, "user", "d." * 100_000), (2, 3, "assistant", "e.")]
    turns = spark.createDataFrame(rows, TURNS).withColumn("flags", F.lit("kept")).withColumn("EDIT", F.lit(1))
    got = {r["conv_id"]: r for r in convrepair.audit(turns).collect()}
    assert got[1]["audit"] == "KDKD" and got[1]["gaps"] == 3 and got[1]["duplicate"] == 1
    assert got[2]["gaps"] == 0 and got[2]["cost"] == 2  # of one turn, the assistant's row comes first
    assert got[None]["blank"] == 1 and got[None]["cost"] == 4 and got[None]["repaired_sha256"] == sha256(b"").hexdigest()
    gone = convrepair.audit(turns.withColumn("dropped", F.lit(True))).collect()
    assert len(gone) == 3 and all((r["cost"], r["gaps"], r["audit"], r["repaired_sha256"]) == (0, 0, "", sha256(b"").hexdigest()) for r in gone)
    assert convrepair.repair_digest(turns).count() == 3 and convrepair.repair_digest(turns.where("false")).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "Yes. No!") for c in range(40) for t in range(5)]
    got = defaultdict(list)
    for r in convrepair.damage(spark.createDataFrame(rows, TURNS)).collect():
        got[r["conv_id"], r["turn"]].append((r["role"], r["text"], r["dropped"]))
    expected = {0: [("assistant", "", True)], 1: [("assistant", "", False)], 2: [("assistant", "Yes No", False)], 3: [("assistant", "Yes. No!", False)] * 2, 4: [("user", "Yes. No!", False)]}
    for c, t, role, text in rows:
        assert got[c, t] == expected.get(zlib.crc32(f"{c}:{t}".encode()) % 20, [(role, text, False)])


# Pieces

ODD = ["", " ", "  ", "a  b ", "▁ab ▁ ▁▁", "<s></s><unk><0x0A>", "a\x00b", "\n\t x", "日本語 한국어 🙂🙂 ½ ²", "𐍈𐍉 x", "　ａ Å ﬁ é", "a" * 3000, "!?" * 500, " " * 40 + "x", "12 345 ٣٤"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary_path(pieces.VOCABULARY))


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(vocabulary_path(pieces.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.sampled_from(ODD), st.text(max_size=60), st.text(alphabet="ab e the in▁\n日🙂é<0x>", max_size=60)))
def test_pieces_equal_the_library(library, model, text):
    ids = library.encode(text, add_eos=True)
    assert model.encode(text, end=True) == ids and model.decode(ids) == library.decode(ids)
    assert model.digest(text) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_decoding_equals_the_library(library, model, ids):
    assert model.decode(ids) == library.decode(ids)


def test_pieces_of_all_documents(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = pieces.piece_digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest())
    small = pieces.Pieces(vocabulary_path(pieces.VOCABULARY))
    monkeypatch.setattr(pieces, "UNITS", 50)  # a memory that is full again and again changes nothing
    monkeypatch.setattr(pieces, "PAIRS", 50)
    for text in list(texts.values())[:20]:
        assert small.encode(text) == library.encode(text) and small.digest(text)[0] == len(library.encode(text)) + 1


def test_pieces_round_trip_as_columns(spark):
    long = "".join(chr(97 + (i * i) % 26) for i in range(300_000))
    rows = [(1, None), (2, ""), (3, " two  spaces "), (4, long), (4, long), (5, "é🙂\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("N_Tokens", F.lit(2))
    back = docs.select("doc_id", "text", pieces.encode(F.col("text")).alias("ids")).withColumn("back", pieces.decode(F.col("ids"))).collect()
    assert all(r["back"] == (r["text"] or "") and r["ids"][-1] == 2 for r in back)
    got = pieces.piece_digest(docs).collect()
    assert [r["n_tokens"] for r in got[:2]] == [1, 1] and len(got) == 6 and pieces.piece_digest(docs.where("false")).count() == 0
