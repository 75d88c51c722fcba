import os
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import token_files

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(library, rows):
    """doc_id, start, ids of the documents in the file order, straight from the library."""
    import xxhash

    tie = lambda t: 42 if t is None else np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, int(tie(r[1] or "")), r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, at, ids))
        at += len(ids)
    return out


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["the ", "The", "don't", " 12", "345", "\n\n", "  ", "\t", "é", "\U0001f600", "中文", "...", " (", "<|endoftext|>", " ", "I'll", "ſ", " ", "x\r\n", "_a_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("split", [token_files.SPLIT, None])
def test_files_hold_the_ids_of_the_library(spark, docs_of, library, tmp_path, split):
    rows = [(i * 7 % 400, t) for i, t in enumerate(texts(1, 300))] + [(5, "tie"), (5, "a tie"), (5, "tie"), (None, "no id"), (None, None), (3, None), (4, "")]
    docs = docs_of([(d, t, None, None) for d, t in rows]).repartition(7)
    manifest = token_files.write(docs, str(tmp_path), PATH, 2, split)
    want = plain(library, rows)
    found = token_files.read_ids(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], list(r["ids"])) for r in found] == want
    sums = token_files.read_digests(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums] == [(d, a, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, a, i in want]
    # The format itself: shard by shard the files are the corpus, and nothing else is left in the folder.
    shards = sorted(manifest.collect(), key=lambda r: r["part"])
    flat = np.concatenate([np.fromfile(tmp_path / f"{r['name']}.ids", r["ids_type"]) for r in shards])
    assert flat.tolist() == [x for _, _, ids in want for x in ids]
    offsets = [np.fromfile(tmp_path / f"{r['name']}.offsets", "<u8").tolist() for r in shards]
    assert all(a[-1] == b[0] for a, b in zip(offsets, offsets[1:])) and offsets[-1][-1] == len(flat)
    assert sum(map(len, offsets)) == len(rows) + len(shards)
    kept = {f"{r['name']}.{k}" for r in shards for k in ("ids", "offsets", "docs")}
    assert {f for f in os.listdir(tmp_path) if not f.startswith(".")} == kept | {"manifest"}


def test_no_rows(spark, docs_of, tmp_path):
    assert token_files.write(docs_of([]), str(tmp_path), PATH).collect() == []
    assert token_files.read_digests(spark, str(tmp_path)).collect() == []


def test_a_long_text_is_cut_between_words(library, monkeypatch):
    monkeypatch.setattr(token_files, "WINDOW", 50)
    monkeypatch.setattr(token_files, "CACHED_WORDS", 20)
    encoder = token_files.Encoder(PATH, token_files.SPLIT, 2)
    for t in [*texts(3, 60), " ".join(texts(4, 60)), "a" * 500, "a  b " * 100, " " * 300, "x y" * 90]:
        t = t.replace("<|endoftext|>", "")
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids + [2]
    many = [t * k for k, t in enumerate(texts(9, 40))]
    assert [np.frombuffer(x, "<u2").tolist() for x in map(encoder.encode, many)] == [library.encode(t, add_special_tokens=False).ids + [2] for t in many]
    assert len(encoder.known) <= 20
    assert "".join(token_files.windows("a b " * 200)) == "a b " * 200


def test_files_of_failed_attempts_are_not_read(spark, docs_of, tmp_path):
    (tmp_path / "000000-dead.ids").write_bytes(b"\x01\x00" * 9)
    (tmp_path / "000000-dead.lengths").write_bytes(b"\x00" * 8)
    token_files.write(docs_of([(1, "a b", None, None)]), str(tmp_path), PATH, 2, token_files.SPLIT)
    assert not [f for f in os.listdir(tmp_path) if "dead" in f]
    assert [(r["doc_id"], r["start"]) for r in token_files.read_digests(spark, str(tmp_path)).collect()] == [(1, 0)]


def test_wide_ids():
    assert token_files.Encoder(PATH, None, 70_000).ids_type == "<u4"
