import zlib

import numpy as np
import pyarrow.parquet as pq
import zstandard

from tallyweave.llm import language as lg
from tallyweave.llm.queries import language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in language_id(spark, SF).collect()}
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"])
    held = [(lang, rows[i].lang_pred) for i, lang in zip(t["doc_id"].to_pylist(),
                                                         t["lang"].to_pylist())
            if rows[i].held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
                                     and 0 <= r.score <= 1 for i, r in rows.items())
    assert sum(a == b for a, b in held) / len(held) > 0.97


TEXTS = {"aa": ["lorem ipsum dolor sit amet " * 5, "dolor amet lorem " * 9],
         "bb": ["the quick brown fox jumps over dogs " * 5]}


def test_sizes_against_plain_zstandard():
    known = lg.Dictionaries(TEXTS)
    text = "quick dolor foxes " * 900
    sizes = [0, 0]
    for at in range(0, len(text), lg.BLOCK):
        for i, content in enumerate(known.contents):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=lg.LEVEL, dict_data=d, write_content_size=False,
                                         write_dict_id=False)
            data = c.compress(text[at:at + lg.BLOCK].encode())
            out = zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(data)
            assert out.decode() == text[at:at + lg.BLOCK]
            sizes[i] += len(data)
    assert lg.encoded_sizes(known.compressors(), text).tolist() == sizes


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "Quick Brown FOX jumps"), (5, "dolor sit"),
            (6, "the fox " * 60_000), (4, "dolor"), (None, "zzz"), (7, "dogs")]
    got = {(r.id, r.lang_pred) for r in lg.identify(docs_of(rows), "doc_id", "text",
                                                    lg.Dictionaries(TEXTS)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (5, "aa"), (6, "bb"), (4, "aa"),
            (7, "bb")} <= got and len(got) == 9
    none = lg.identify(docs_of(rows), "doc_id", "text", lg.Dictionaries({})).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert lg.identify(docs_of(rows).limit(0), "doc_id", "text",
                       lg.Dictionaries(TEXTS)).count() == 0


def test_sample_is_bounded(spark):
    rows = [(i, f"text {i} " * 300, "aa" if i % 50 else "bb") for i in range(5000)]
    df = spark.createDataFrame(rows + [(1, "x", None), (2, None, "cc"), (None, "y", "dd")],
                               "k long, text string, lang string")
    got = lg.sample_texts(df, "text", "lang", "k")
    assert len(got["aa"]) == lg.DOCS_PER_LANGUAGE and len(got["bb"]) == 100 and got["dd"] == ["y"]
    assert "cc" not in got and max(map(len, got["aa"])) <= lg.CHARS_PER_DOC
    assert lg.sample_texts(df.limit(0), "text", "lang", "k") == {}


def test_bodies_are_learnt_behind_a_common_opening(spark):
    menu = "licence menu terms " * 90  # longer than CHARS_PER_DOC
    words = [f"b{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    rows = [(i, menu + f"{words[i]} " * 600, "aa") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, text string, lang string")
    got = lg.sample_texts(df, "text", "lang", "k")
    assert len(got["aa"]) == 400 and max(map(len, got["aa"])) <= lg.CHARS_PER_DOC
    (content,) = lg.Dictionaries(got).contents
    assert len(content) <= lg.DICTIONARY_BYTES
    assert sum(w.encode() in content for w in words) >= 240  # three of five pieces are body


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(260):  # more languages than once were learnt
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)]
        rows += [(10 * k + i, " ".join(rng.choice(words, 30)), f"l{k:03d}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = lg.sample_texts(df, "text", "lang", "doc_id")
    assert len(texts) == 260 and all(len(t) == 3 for t in texts.values())
    learnt = lg.Dictionaries(texts)
    assert sum(map(len, learnt.contents)) <= lg.ALL_BYTES
    judge = lg.Identifier(learnt, 0.02)
    assert all(judge(rows[i][1])[0] == rows[i][2] for i in range(0, len(rows), 60))
    assert lg.documents_each(4) == lg.DOCS_PER_LANGUAGE
    assert 20 <= lg.documents_each(7000) < lg.DOCS_PER_LANGUAGE


def test_equal_sizes_go_to_the_dictionary_that_knows_the_words():
    texts = {"a": ["zzz yyy xxx"], "b": ["one two three"], "c": ["one two three"]}
    judge = lg.Identifier(lg.Dictionaries(texts), 0.02)
    lang, score, sure = judge("one two three")
    assert lang == "b" and score == 0.0 and not sure  # b and c need the same bytes


def test_predictions_against_plain_compression():
    rng = np.random.default_rng(4)
    texts = {k: [" ".join(rng.choice([f"{k}{w}" for w in "abcdefgh"], 200))] for k in "pqr"}
    learnt = lg.Dictionaries(texts)
    judge = lg.Identifier(learnt, 0.02)
    for k in "pqr":
        text = " ".join(rng.choice([f"{k}{w}" for w in "abcdefgh"], 40))
        sizes = {}
        for name, content in zip(learnt.languages, learnt.contents):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=learnt.level, dict_data=d, write_content_size=False,
                                         write_checksum=False, write_dict_id=False)
            sizes[name] = len(c.compress(lg.letters_only(text).encode()))
        assert judge(text)[0] == min(sizes, key=sizes.get) == k
