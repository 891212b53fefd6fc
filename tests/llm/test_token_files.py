import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import token_files as tf
from tidemill.llm.queries import tokenizer_path

ALPHABET = "abzAZ09'stTremMvlLdD.,!?-_<|>éÉßñÑçöÄ÷×²½Σσςİı日🙂́ \x1c\x85 \n\t"


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    data = tf.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8) and (tf.unpack(data, bits, len(ids)) == ids).all()


def test_bits_of_a_vocabulary():
    assert [tf.bits_for(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name):
    encoder = tf.WordEncoder(tokenizer_path(name), 1, most=500)
    rng = random.Random(2)
    texts = ["", None, "  x ", "a <|startoftext|>é a<|endoftext|>b don't", "İx ŉ ½ ²3 ΑΣ ẞ ﬁ", "'S 'RE'm it's'll123 ''s $$$&& a_b-c ÷×ÀÉß"]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(80))) for _ in range(600)]
    for _ in range(2):
        ids, at = encoder.encode(pa.array(texts))
        assert len(at) == len(texts) + 1
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], t


def test_random_access(tmp_path):
    path = str(tmp_path / "x.tok")
    ids = np.arange(100_000, dtype=np.uint32) * 7 % 8191
    with open(path, "wb") as f:
        w = tf.TokenFileWriter(f, 13, 1000)
        w.add(np.array([5, 6]), ids[:70_001], np.array([0, 0, 70_001]))
        w.add(np.array([9]), ids[70_001:], np.array([0, 29_999]))
        w.close()
    file = tf.TokenFile(path)
    for a, b in ((0, 0), (0, 1), (999, 1001), (69_990, 70_020), (0, 100_000), (99_999, 100_000)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert file.docs.tolist() == [5, 6, 9] and file.starts.tolist() == [0, 0, 70_001, 100_000]
    assert sum(len(i) for _, _, i in file.documents(10)) == 100_000


def test_table_matches_the_tokenizer(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    docs = [(i * 37 % 101, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(200))), "x") for i in range(101)]
    docs += [(None, "null id", "x"), (7_000, None, "x"), (7_001, "word " * 40_000, "x"), (5, "again", "x"), (5, "again", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, start string").repartition(5)
    got = tf.token_table(df, tokenizer_path(), partitions=4).collect()
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, t, _ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got.sort(key=lambda r: r["start"])
    starts = np.cumsum([0, *[w[1] for w in want[:-1]]]).tolist()
    have = [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got]
    same_id = lambda rows: sorted(map(repr, rows))  # noqa: E731  rows of one id may come in either order
    assert [r["start"] for r in got] == starts and [h[0] for h in have] == [w[0] for w in want] and same_id(have) == same_id(want)


def test_ids_of_documents_and_empty_table(spark):
    df = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    manifest = tf.write_token_files(df, tokenizer_path())
    row = tf.read_token_files(spark, manifest, with_ids=True).first()
    assert len(row["ids"]) == row["n_tokens"] and row["ids"][-1] == 1
    assert tf.token_table(df.limit(0), tokenizer_path()).count() == 0
