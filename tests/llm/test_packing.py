import zlib
from array import array

import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm.packing import Encoder, pack


@pytest.fixture(scope="module")
def plain():
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 1]


def check(docs, plain, length):
    pieces = [r.asDict() for r in pack(docs, length).withColumn("crc", F.crc32("ids")).collect()]
    expected = [(r["doc_id"], plain(r["text"])) for r in docs.collect()]
    assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in expected)
    stream = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    place = {}
    for p in stream:  # gapless from 0
        assert p["offset"] == place.get(p["sequence_id"], 0)
        place[p["sequence_id"]] = p["offset"] + p["length"]
        ids = array("I", bytes(p["ids"]))
        assert len(ids) == p["length"] and p["crc"] == zlib.crc32(bytes(p["ids"]))
    assert all(n == length for s, n in place.items() if s != max(place))
    whole, current = [], []
    for p in stream:
        if p["start"] == 0:
            current = []
        assert len(current) == p["start"]
        current = current + list(array("I", bytes(p["ids"])))
        if len(current) == p["doc_tokens"]:
            whole.append((p["doc_id"], current))
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(whole, key=key) == sorted(expected, key=key)


def test_documents(small, plain):
    check(small.repartition(5), plain, 2048)


def test_odd_rows(odd, plain):
    check(odd.repartition(3), plain, 64)


def test_empty(empty):
    assert pack(empty).count() == 0


def test_parts_give_the_ids_of_whole_texts(plain):
    encoder = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, limit=5)
    texts = ["a  b", "  a", "a  ", "a\n\nb", "I'm we'll 'x", "1,234.5%  \t\n x", "é–ü “q”", "\r\n\r\na", "   a", "a\x1cb", "a \x85 b", "½²ª", "x<|endoftext|>y", "中 Жд"]
    for text in texts:
        assert list(array("I", encoder.ids(text))) == plain(text)[:-1], text


def test_the_model_file_is_loaded_for_rare_texts_only(plain):
    """A task holds one vocabulary, not two, until a text needs the other."""
    encoder = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    ids = lambda text: [*array("I", encoder.ids(text)), 1]
    assert ids("plain words, 12 of them") == plain("plain words, 12 of them") and "_whole" not in vars(encoder)
    assert ids("rare \u4e2d\u6587") == plain("rare \u4e2d\u6587") and "_whole" in vars(encoder)
