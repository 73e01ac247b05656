import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing
from cairn.llm.queries import vocabulary

HARD = ["", " ", "a  b", "  x", "x ", "\n\n a", "a\n b", "it's  x", "<|endoftext|> hi <|endoftext|>", "a\tb c",
        "don't stop", "日本 語", "x  y", "a b c", "12 34.5!", "\r\n a", "² ³x", "é é", "I'LL we'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [packing.END]


def test_ids_are_the_librarys(docs, library):
    texts = HARD + [r["text"] for r in docs.collect()]
    found = packing.Encoder(vocabulary(), limit=50).encode(pa.array(texts))
    assert [x.tolist() for x in found] == [ids(library, t)[:-1] for t in texts]


def check(rows, texts, library):
    want, length = Counter(), 0
    for doc, text in texts:
        every = ids(library, text)
        length += len(every)
        for n, (begin, size) in enumerate(packing.cut(len(every), 1024)):
            part = np.array(every[begin:begin + size], "<u4").tobytes()
            want[doc, n, begin, size, zlib.crc32(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, size in sorted(spans):
            assert offset == at
            at += size
        assert at <= 1024
    return len(bins), -(-length // 1024)


def test_all_documents_gapless_and_tight(odd, clashing, docs, library):
    for df in (odd, clashing, docs):
        found, least = check(packing.packed(df, vocabulary()).collect(), [(r["doc_id"], r["text"]) for r in df.collect()], library)
        assert found <= least + max(1, least // 50)


def test_cut():
    assert list(packing.cut(1, 4)) == [(0, 1)] and list(packing.cut(4, 4)) == [(0, 4)]
    assert list(packing.cut(9, 4)) == [(0, 1), (1, 4), (5, 4)]


def test_two_fit_replaces_the_smallest():
    left = np.zeros(11, np.int64)
    for size in (7, 2, 3, 1):
        left[size] += 1
    # Greedy alone: 7 + 3. Nothing to gain there.
    assert packing._fill(left, 10) == {7: 1, 3: 1}
    left = np.zeros(13, np.int64)
    for size, n in ((8, 1), (3, 1), (2, 2)):
        left[size] = n
    # Greedy takes 8 + 3 and leaves 1; 8 + 2 + 2 fills it.
    assert packing._fill(left, 12) == {8: 1, 2: 2}


def test_sequences_hold_the_ids(docs, library):
    rows = packing.sequences(packing.packed(docs, vocabulary(), with_ids=True)).collect()
    texts = {r["doc_id"]: ids(library, r["text"]) for r in docs.collect()}
    back = defaultdict(dict)
    for r in rows:
        for s in r["spans"]:
            back[s["doc_id"]][s["piece"]] = r["ids"][s["offset"]:s["offset"] + s["length"]]
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in back.items()} == texts


def test_empty_table(none):
    assert packing.packed(none, vocabulary()).count() == 0
