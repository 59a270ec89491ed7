import io
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from veilwork.llm import token_records as tr
from veilwork.llm.queries import QUERIES, WORD_BPE

ROOT = "/root/testdata/sf0.01"
TEXTS = ["", " ", "Hello, WORLD's  end\n", "á é  x y", "x" * 9000, "<|endoftext|> a<|startoftext|>b", "日本語 123 don't", "Σίσυφος ΟΔΟΣ", "ab " * 4000]


def plain(text):
    return [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, 1]


def test_words_give_the_ids_of_whole_texts():
    for text, ids in zip(TEXTS, tr.encode_texts(WORD_BPE, [t.encode() for t in TEXTS], 1), strict=True):
        assert ids.tolist() == plain(text)


def test_frames_and_damage():
    for key, ids in ((5, [1, 2, 65535]), (None, []), (-7, [70000, 1])):
        record = tr.frame(key, np.array(ids, np.uint32))
        back = tr.unframe(io.BytesIO(record))
        assert back[0] == key and back[1].tolist() == ids
        for at in range(len(record)):
            damaged = bytearray(record)
            damaged[at] ^= 4
            with pytest.raises(ValueError):
                tr.unframe(io.BytesIO(bytes(damaged)))
    assert tr.unframe(io.BytesIO(b"")) is None


def test_files(spark, tmp_path):
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (-3, None, "y"), (4, "twice", "z"), (4, "twice", "z")]
    random.Random(0).shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(3)
    manifest = tr.write_records(frame, WORD_BPE, part_chars=5000)
    assert manifest.count() > 2
    got = sorted((tuple(r) for r in tr.read_records(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d[0] for d in docs), key=lambda v: (v is not None, v))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    expected = sorted(((d, len(plain(t)), zlib.crc32(np.array(plain(t), "<u4").tobytes())) for d, t, _ in docs), key=repr)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == expected
    shuffled = tr.read_shuffled(manifest, 3).collect()
    assert sorted(((r.doc_id, r.ids) for r in shuffled), key=repr) == sorted(((d, plain(t)) for d, t, _ in docs), key=repr)
    assert tr.read_records(tr.write_records(frame.where("false"), WORD_BPE)).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").toPandas().sort_values("doc_id")
    got = QUERIES["op6_token_records"](spark, ROOT).toPandas().sort_values("doc_id")
    tokenizer = Tokenizer.from_file(WORD_BPE)
    ids = [[*e.ids, 1] for e in tokenizer.encode_batch(docs["text"].tolist(), add_special_tokens=False)]
    assert got["n_tokens"].tolist() == list(map(len, ids))
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    assert got["start"].tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
