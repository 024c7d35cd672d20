"""Fill-in-middle, ranked search and token files: brute force, round trips, and the defined cases."""

import collections
import hashlib
import math
import os
import random
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from eventloom.llm import fill_in_middle as fim
from eventloom.llm import ranked_search as rs
from eventloom.llm import textcodes as tc
from eventloom.llm import token_files as tf
from eventloom.llm import token_ids as ti

EXTRA = "n string, form int, output string, pieces int, restored int, rank string, score string, doc string, terms int, start int, ids int"
VALUES = ("x", 1, "x", 1, 1, "x", "x", "x", 1, 1, 1)


def odd(spark, texts):
    return spark.createDataFrame([(i, t, *VALUES) for i, t in texts], f"doc_id long, text string, {EXTRA}").repartition(3)


def arranged(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
    return n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), out


def test_fill_in_middle(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choices(["ab", "Z", "é", "☃", " ", "\n", "<", "P>", ">", "<S", "12", "𝄞"], k=rnd.randrange(0, 60)))) for i in range(1500)]
    texts += [(None, "abc def"), (7, None), (8, ""), (9, "a<P>b"), (10, "<" * 50 + "S>"), (11, "<S"), (12, "x" * 3_000_000 + " yz "), (13, "abc"), (13, "abc"), (13, "other text")]
    rows = fim.restore_texts(fim.fill_in_middle(odd(spark, texts), keep_columns=["doc_id", "text", "rank"])).collect()
    assert len(rows) == len(texts) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == arranged(r.doc_id, text)
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
        assert r.restored == text and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        buffers = (text.encode(), b"".join(fim.SENTINELS))
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()
    assert fim.restore_texts(fim.fill_in_middle(odd(spark, texts).limit(0))).count() == 0


def test_restoring_what_no_arrangement_made(spark):
    cases = [("<P>a<M>b<S>c", "psm", None), ("a", "spm", None), (None, None, ""), (None, "psm", None), ("x", None, "x"), ("<S>a<P>b<M>c<M>", "spm", None), ("x<S>a<P>b<M>c", "spm", None), ("<S>c<P>a<M>b", "spm", "abc")]
    got = fim.restore_texts(spark.createDataFrame(cases, "output string, form string, want string")).collect()
    assert len(got) == len(cases) and all(r.restored == r.want for r in got)


def test_piece_table_cuts_and_permutes():
    table = fim.PieceTable.of_texts(np.frombuffer(b"abcdefXYZ", np.uint8), np.array([0, 6, 6, 9]))
    table.cut(np.array([0, 2]), np.array([2, 0]))
    table.cut(np.array([0, 2]), np.array([2, 3]))
    assert table.length.tolist() == [2, 0, 4, 0, 0, 3, 0] and table.first.tolist() == [0, 3, 4, 7]
    table.permute(np.array([0]), (2, 0, 1))
    assert table.texts().to_pylist() == ["cdefab", "", "XYZ"]
    for order in fim.ORDERS.values():
        assert [order[k] for k in fim.inverse(order)] == list(range(6))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k=10):
    split = lambda t: collections.Counter(TERM.findall((t or "").translate(LOWER)))
    counted = [(i, c, sum(c.values())) for i, c in ((i, split(t)) for i, t in docs) if c]
    total, length, df = len(counted), sum(n for _, _, n in counted), collections.Counter()
    for _, c, _ in counted:
        df.update(c.keys())
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 75 + 75 * n * total // length
            score = sum(a * math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m)) for x, a in split(text).items() if x in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


def searchable(seed):
    rnd, words = random.Random(seed), [f"w{i}" for i in range(200)] + ["É", "é", "a1", "Ünï", "x"]
    docs = []
    for i in range(1200):
        text = " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rnd.randrange(0, 40)))
        if docs and rnd.random() < 0.2:
            text = docs[rnd.randrange(len(docs))][1]  # copies: equal scores
        docs.append((rnd.choice([i, i, i, i, None]), text))
    docs += [(5, None), (6, ""), (7, " ,;"), (8, " ".join(words) * 2000), (9, "W5"), (9, "W5")]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(0, 25))).upper()) for i in range(25)] + [(None, "w1 w2"), (3, "w5 w150 w150"), (40, "nowhere")]
    return docs, items


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_docs": 50, "block_docs": 4}, {"shard_docs": 7, "block_docs": 1, "block_terms": 300}])
def test_ranked_search(spark, sizes):
    docs, items = searchable(5)
    asked = spark.createDataFrame([*items, *items[:2], (99, None)], "item_id long, text string")  # repeated and empty items
    got = rs.rank_documents(odd(spark, docs), asked, **sizes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_rows(got) == sorted(ranked(docs, items), key=repr)
    if not sizes:
        assert rs.rank_documents(odd(spark, docs).limit(0), asked).count() == 0 and rs.rank_documents(odd(spark, docs), asked.limit(0)).count() == 0


def test_blocks_are_bounded_and_skipped():
    """Every summary bounds its documents, and blocks below the threshold aren't scored."""
    rnd = np.random.default_rng(3)
    rows = [np.sort(rnd.choice(60, rnd.integers(1, 12), replace=False)) for _ in range(300)]
    at, terms = np.append(0, np.cumsum([len(r) for r in rows])), np.concatenate(rows)
    impacts = rnd.integers(1, 1000, len(terms))
    blocks = rs.make_blocks(at, terms, impacts, 8)
    shard = rs.Shard({"docs": np.arange(300), "row_at": at, "terms": terms, "impacts": impacts} | blocks)
    item = (np.array([3, 17, 40]), np.array([900, 500, 3]))
    weight = np.zeros(61, np.int64)
    weight[item[0]] = item[1]
    for b, term in enumerate(shard.block_term):
        bound = shard.bounds(b, b + 1, weight)[0]
        for d in shard.documents(np.array([b])):
            own = {t: x for t, x in zip(terms[at[d] : at[d + 1]], impacts[at[d] : at[d + 1]], strict=True) if t >= term}
            assert sum(weight[t] * x for t, x in own.items()) <= bound
    weight[:] = 0
    best = rs.Best(3, 0)
    scored = rs.search_shard(shard, item, weight, best)
    dense = np.zeros((300, 61), np.int64)
    dense[np.repeat(np.arange(300), np.diff(at)), terms] = impacts
    every = dense[:, item[0]] @ item[1]
    assert best.score.tolist() == sorted(every.tolist(), reverse=True)[:3] and not weight.any()
    assert 0 < scored < (every > 0).sum()


def test_impacts_beyond_64_bits():
    got = rs.impact(np.array([3, 1]), np.array([10**9, 5]), 10**11, 10**13)
    assert got.tolist() == [10**9 * 3 // (3000 + 8 * (25 + 75 * 10**9 * 10**11 // 10**13)), 10**9 // (1000 + 8 * (25 + 3))]


ALPHABET = ["ab", "Z", " ", "  ", "\n", "\t", "é", "à", " the", "<|endoftext|>", " ", " ", "　", "\x1c", "\x1f", "\x85", "𝄞", "☃", "1", "23", "'s", "'ll", ".", ",", "-", "x-", "don't", "×", "÷", "\r", "\x0b", "ß", "Ω", "Я"]
needs_file = pytest.mark.skipif(not os.path.exists(tf.DEFAULT_TOKENIZER), reason="no tokenizer here")


@needs_file
def test_chunks_give_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(ti, "SLICE_BYTES", 3000)
    monkeypatch.setattr(ti, "REMEMBERED", 2000)  # forgets now and then
    rnd, library, own = random.Random(1), Tokenizer.from_file(tf.DEFAULT_TOKENIZER), ti.Encoder(tf.DEFAULT_TOKENIZER)
    texts = ["".join(rnd.choices(ALPHABET, k=rnd.randrange(0, 30))) for _ in range(5000)] + ["", "   ", None, "a" * 20_000, "a b " * 9000]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, counts = own.encode(*tc.text_buffers(pa.array(texts)))
    assert own.chunked and counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    own.chunked = False
    whole, same = own.encode(*tc.text_buffers(pa.array(texts[:500])))
    assert same.tolist() == counts[:500].tolist() and whole.tolist() == ids[: len(whole)].tolist()


@needs_file
@pytest.mark.parametrize("length", [1, 7, 2048])
def test_token_files(spark, length):
    from tokenizers import Tokenizer

    rnd, library = random.Random(2), Tokenizer.from_file(tf.DEFAULT_TOKENIZER)
    rows = [(rnd.randrange(400) if i % 9 else None, "".join(rnd.choices(ALPHABET, k=rnd.randrange(0, 30)))) for i in range(600)] + [(5, None), (6, ""), (7, "long text " * 60_000)]
    path = f"file://{tempfile.mkdtemp()}/tokens"
    tf.write_token_files(odd(spark, rows), path, length=length)
    got, want, start = {}, {}, 0
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in sorted(tf.read_token_files(spark, path).collect(), key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert list(got) == [*sorted(k for k in got if k is not None), None]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    files, rows = tf.TokenFiles(path), tf.read_token_files(spark, path, "sequences").orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(len(files))) and sum(sum(r.mask) for r in rows) == start
    for r in rnd.sample(rows, min(20, len(rows))):
        assert files[r.sequence].tolist() == r.ids and files.mask(r.sequence).to_pylist() == r.mask and len(r.ids) == length
    assert not files[0].flags.owndata  # a view of the mapped file
    with pytest.raises(IndexError):
        files[len(files)]


@needs_file
def test_token_files_again_and_empty(spark):
    path = f"file://{tempfile.mkdtemp()}/tokens"
    docs = odd(spark, [(2, "b"), (1, "a")])
    tf.write_token_files(docs, path)
    with pytest.raises(Exception, match="has token files"):
        tf.write_token_files(docs, path)
    docs.select("doc_id", "text").limit(1).write.format("token_ids").mode("overwrite").save(path)
    assert tf.read_token_files(spark, path).count() == 1 and len(os.listdir(path[7:])) == 2
    none = f"file://{tempfile.mkdtemp()}/tokens"
    tf.write_token_files(docs.limit(0), none)
    assert tf.read_token_files(spark, none).count() == 0 and len(tf.TokenFiles(none)) == 0
