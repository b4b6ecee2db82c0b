import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from palimpsest.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, WORLD's end! a-b 3.14 don't", "é, É. œuvre ÑAND… ΣΊΣΥΦΟΣ İx <|endoftext|>y <|ENDOFTEXT|>  z\x1cq é Ⅷ²a", "the " * 5000, "x" * 3000, "a\tb\nc\r\nd\x0be", "日本語、テキスト!! 'S 'tis rock'n'roll's..."]


def test_ids_equal_the_tokenizer():
    t, ids = Tokenizer.from_file(PATH), packing.WordIds(PATH, most=50)
    for x in TEXTS:
        want = t.encode(x or "", add_special_tokens=False).ids
        assert np.frombuffer(ids.of((x or "").encode()), "<u4").tolist() == want, x


def test_pieces_cover_each_document_once(spark):
    rows = [(i, x, "extra") for i, x in enumerate(TEXTS)] + [(None, "null id", "e"), (2, TEXTS[2], "again")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH, 1024).collect()
    t = Tokenizer.from_file(PATH)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, x in enumerate(TEXTS):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[i], key=lambda r: r.start)[:: 2 if i == 2 else 1]
        assert b"".join(bytes(r.input_ids) for r in parts) == np.array(want, "<u4").tobytes()
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(bytes(r.input_ids)) for r in parts)
    assert None in by and len(by[2]) % 2 == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
