"""The transducers against the SentencePiece library, and a unigram model against brute force."""

from __future__ import annotations

import random
import struct
import zlib
from itertools import product

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from docspark.llm import wfst
from docspark.llm.queries import op1_sentencepiece, vocabulary

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return wfst.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabetionths.,<>0x41ÿé日😀̈\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_library(text):
    m, library = wfst.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = text.replace("\x00", "")
    assert m.encode(text) == library.encode(text)
    if wfst.BLANK not in text:
        assert m.decode(library.encode(text)) == text


@pytest.mark.parametrize("text", ["", " ", " " * 37 + "x" + " " * 18, "a" * 500, "<s> <0x41> </s>", "x▁y", "int main() {\n        return 0;\n}"])
def test_edges(both, text):
    m, library = both
    assert m.encode(text) == library.encode(text)


def test_long_text(both):
    m, library = both
    text = "thetionble" * 20_000
    assert m.encode(text) == library.encode(text)


def test_unigram_is_the_least_weight_path():
    entries = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    entries += [(x, s, 1) for x, s in {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -3.5, "ba": -4.0, "abb": -6.0}.items()]
    m = wfst.Model(entries, wfst.UNIGRAM)
    score = {x: s for x, s, _ in entries[257:]}

    def best(word):
        options = []
        for cuts in product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            if all(p in score for p in parts):
                options.append(sum(score[p] for p in parts))
        return max(options)

    for n in range(1, 7):
        for word in map("".join, product("ab", repeat=n)):
            ids = m.encode(word)
            assert sum(m.scores[i] for i in ids) == pytest.approx(best("▁" + word))
            assert m.decode(ids) == word
    assert m.decode(m.encode("aé")) == "aé"


def test_rules_rewrite_by_longest_match():
    entries = [("<unk>", 0.0, 2)] + [(x, -1.0, 1) for x in "▁xyz"]
    m = wfst.Model(entries, wfst.UNIGRAM, byte_fallback=False, rules={"ab": "x", "a": "y", "ﬁ": "z"})
    assert m.normalise("ab aﬁ") == "▁x▁yz"
    assert m.encode("q") == [1, 0]


def test_table(spark, sf_dir):
    rows = op1_sentencepiece(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["same"] and (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        assert r["n_fallback"] == sum(library.is_byte(i) for i in ids)


@pytest.fixture(scope="module")
def mapped(tmp_path_factory):
    """A unigram model of few pieces with a public normaliser's compiled character map, and extra blanks removed."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    assert proto.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.add_dummy_prefix = proto.normalizer_spec.remove_extra_whitespaces = proto.normalizer_spec.escape_whitespaces = True
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = wfst.UNIGRAM, True
    del proto.pieces[:]
    r = random.Random(7)
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    listed += [(x, -r.uniform(1, 9), 1) for x in ("▁", "a", "b", "c", "ab", "ba", "▁a", "▁ab", "bc", "abc", "fi", "▁fi", "1", "12", "ア", "が", "▁▁")]
    for name, score, kind in listed:
        proto.pieces.add(piece=name, score=score, type=kind)
    path = str(tmp_path_factory.mktemp("model") / "mapped.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    return wfst.model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_compiled_character_map(mapped):
    m, library = mapped

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.sampled_from(list("abc fi12ﬁ①Ⅻａｱｶﾞ㍿　\u00a0\u200b\t\r\n\u00adéé½xか\u3099\ufeff ")), max_size=30))
    def same(text):
        assert m.normalise(text) == library.normalize(text)
        assert sum(m.costs[i] for i in m.encode(text)) == pytest.approx(sum(m.costs[i] for i in library.encode(text)))
        assert m.encode(text) == library.encode(text)

    same()


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "a b", 7), (None, "a b", 7)], "doc_id long, text string, n_ids int")
    rows = sorted(wfst.encode_documents(docs, PATH).select("n_ids", "same").collect())
    assert [tuple(r) for r in rows] == [(0, True), (0, True), (2, True), (2, True)]
    assert wfst.encode_documents(docs.limit(0), PATH, with_ids=True).collect() == []
