import os
import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripwire.llm import token_files as T
from tripwire.llm.queries import QUERIES
from tripwire.session import checkpoint_dir

from .conftest import SF


def whole(texts, name=T.VOCABULARY):
    """Every text encoded whole by the library, without any memory."""
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [e.ids + [T.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.fixture
def path(spark):
    return f"{checkpoint_dir(spark)}/tokens-test-{uuid.uuid4().hex}"


def test_whole_table_equals_brute_force(spark, texts_sf):
    docs = texts_sf.sort_values("doc_id")
    ids = whole(docs.text)
    n = np.array([len(x) for x in ids])
    want = list(zip(docs.doc_id, np.cumsum(n) - n, n, [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]))
    got = QUERIES["op12_token_files"](spark, SF).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


ODD = ["a  b", " lead", "trail  ", "x \n y", "\n\n", "tab\t tab", "nb  x  y", "  em  space", "it's  we'll ''s", "\x1c \x1d a",
       "<|endoftext|> end", "日本語 テキスト  x", "é́ ü ", "😀 😀‍", "a\r\n b", "1st ½ ²  3", "　全 角", "", None, " ", "  ", "\n a\n  b"]


def encoded(encoder, texts):
    return encoder(pa.array(texts, pa.string()), T.END).to_pylist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_equal_whole_texts(name):
    encoder = T.Encoder(name)
    assert encoder.by_word == (name == "byte_bpe_50k.json")
    plain = ["one two", "it's  we'll", "a\nb c", "", " lead", "x \ny", "日本語 テキスト", "é́ ü", "two one one", "don't 'till \tx"]
    for texts in (ODD, ODD[::-1], plain, plain + ODD, plain * 3, ["only"]):
        assert encoded(encoder, texts) == whole(texts, name)
    assert encoded(encoder, []) == []


@pytest.mark.parametrize("remembered", [10, 1000, 1 << 20])
def test_many_distinct_words_are_told_apart(monkeypatch, remembered):
    monkeypatch.setattr(T, "REMEMBERED", remembered)
    encoder = T.Encoder(T.VOCABULARY)
    rnd = random.Random(1)
    texts = [" ".join("".join(rnd.choices("abcé'\u65e5.,7", k=rnd.randint(1, 9))) for _ in range(300)) for _ in range(20)]
    for at in (0, 3, 0, 9):
        assert encoded(encoder, texts[at:at + 8]) == whole(texts[at:at + 8])


def test_frequent_words_stay_remembered(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 100)
    asked = []
    after_space = T.Encoder._after_space
    monkeypatch.setattr(T.Encoder, "_after_space", lambda self, words: asked.extend(words.to_pylist()) or after_space(self, words))
    encoder = T.Encoder(T.VOCABULARY)
    for call in range(9):
        texts = ["the " + " ".join(f"often{i}" for i in range(30)), "rare " + " ".join(f"only{call}x{i}" for i in range(40)), "it's\nodd a", None]
        assert encoded(encoder, texts) == whole(texts)
        assert len(encoder.words) == len(encoder.lists) == len(encoder.met) <= 100
    assert [w for w in asked if w.startswith("often")] == [f"often{i}" for i in range(30)]
    assert sorted(w for w in asked if w.startswith("only")) == sorted(f"only{c}x{i}" for c in range(9) for i in range(40))


def test_tasks_of_a_worker_share_its_encoder(spark, make_docs, tmp_path, path):
    encoder = T.encoder_of(T.VOCABULARY)
    assert T.encoder_of(T.VOCABULARY) is encoder
    other = tmp_path / "own.json"
    other.write_bytes(open(public_tokenizers.path("word_bpe_49k.json"), "rb").read())
    assert encoded(T.encoder_of(str(other)), ODD) == whole(ODD, "word_bpe_49k.json")
    other.write_bytes(open(public_tokenizers.path(T.VOCABULARY), "rb").read())
    os.utime(other, ns=(1, 1))
    assert encoded(T.encoder_of(str(other)), ODD) == whole(ODD)  # a file that has changed is read again
    # one worker, tables encoded one after the other, each with another tokenizer
    docs = make_docs([(i, x) for i, x in enumerate(ODD * 2)]).coalesce(1)
    for at, name in enumerate((T.VOCABULARY, "word_bpe_49k.json", T.VOCABULARY)):
        T.write_tokens(docs, f"{path}-{at}", vocabulary=name)
        assert [r.ids for r in T.read_tokens(spark, f"{path}-{at}").orderBy("doc_id").collect()] == whole(ODD * 2, name)


def test_edges(spark, make_docs, path):
    long = "many words " * 30_000
    docs = make_docs([(3, None), (1, ""), (2, "b b"), (2, "b b"), (None, "null id"), (2, "a"), (9, long)])
    docs = docs.withColumn("ids", F.lit("own")).withColumn("start", F.lit(-1)).withColumn("part", F.lit("p")).withColumn("hash", F.lit(0))
    T.write_tokens(docs, path, meta=("ids", "start", "lang"))
    rows = T.read_tokens(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 2, 3, 9]
    assert [r.ids for r in rows[-2:]] == whole([None, long])
    assert sorted(tuple(r.ids) for r in rows[2:5]) == sorted(map(tuple, whole(["b b", "b b", "a"])))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.meta.ids, r.meta.start, r.meta.lang) == (at, len(r.ids), "own", -1, "en")
        at += r.n_tokens


def test_empty_table(spark, make_docs, path):
    T.write_tokens(make_docs([]), path)
    assert T.read_tokens(spark, path).count() == 0 == T.stream_slice(spark, path, 0, 9).count()
    assert T.layout(spark, path).filter("n_rows > 0").count() == 0


def test_format_and_selective_reads(spark, docs_sf, path):
    T.write_tokens(docs_sf, path, row_group=1 << 18, page_rows=50)
    found = T.layout(spark, path).toPandas()
    assert found.groupby("file").row_group.nunique().max() > 1
    assert found.column_index.all() and found.offset_index.all()
    of = {c: set(e for x in g.encodings for e in x) for c, g in found.groupby("column")}
    assert of["doc_id"] == of["start"] == of["n_tokens"] == {"DELTA_BINARY_PACKED"}
    assert "RLE_DICTIONARY" in of["ids.list.element"]

    def plan(df):
        return df._jdf.queryExecution().toString()

    assert "array<int>" not in plan(T.metadata(spark, path)).split("== Physical Plan ==")[1]
    one = T.read_tokens(spark, path, F.col("doc_id") == 7)
    assert "EqualTo(doc_id,7)" in plan(one)
    assert one.first().ids == whole([docs_sf.filter("doc_id = 7").first().text])[0]


def test_slices_of_the_stream(spark, docs_sf, path):
    T.write_tokens(docs_sf, path)
    rows = T.read_tokens(spark, path).orderBy("start").toPandas()
    stream = np.concatenate(rows.ids.to_list())
    for a, b in ((0, 1), (5, 5), (100, 2500), (len(stream) - 3, len(stream) + 9), (len(stream), len(stream) + 1)):
        got = T.stream_slice(spark, path, a, b).orderBy("start").collect()
        assert [x for r in got for x in r.ids] == stream[a:b].tolist()
        assert [r.start for r in got][:1] == ([a] if stream[a:b].size else [])
