"""Token ids against the library over all letters; token files' encodings, indexes and selective reads."""

import glob
import random
import unicodedata

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import token_files
from riskloom.llm.wordbpe import WordBpe, vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def differing(library, texts):
    ids, begins = WordBpe(vocabulary_path()).encode_texts(texts, 1)
    return [t for k, (t, e) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)) if ids[begins[k] : begins[k + 1] - 1].tolist() != e.ids]


def test_every_letter_before_a_sign(library):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    for at in range(0, len(letters), 20000):
        assert differing(library, [f"ab{c}, {c}!" for c in letters[at : at + 20000]]) == []


def test_letters_with_marks(library):
    rnd = random.Random(8)
    marks = [chr(c) for c in range(0x300, 0x360)] + list("İıßſΣςǅ़्") + ["é", "क़", "ﬁ", "½", "'"]
    texts = ["".join(rnd.choice([rnd.choice(marks), rnd.choice("aeiouAEZ"), rnd.choice(".,!?;:&%$#*"), rnd.choice(" \n\t"), "한", "é"]) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    assert differing(library, texts) == [] and differing(library, [unicodedata.normalize("NFD", t) for t in texts]) == []
    assert differing(library, ["İ, क़. ড়! İSTANBUL'DA %"]) == []


def test_token_files_are_encoded_and_read_in_part(spark, library, tmp_path):
    rnd = random.Random(9)
    texts = [(k * 3, " ".join(rnd.choice(["the", "port", "of", "call"]) for _ in range(rnd.randint(0, 300)))) for k in range(3000)]
    out = f"{tmp_path}/files"
    token_files.write_token_files(spark.createDataFrame(texts, "doc_id long, text string"), "file://" + out, file_bytes=1 << 17)
    files = sorted(glob.glob(out + "/*.parquet"))
    assert len(files) >= sum(len(t) for _, t in texts) >> 17
    for path in files:
        meta = pq.ParquetFile(path).metadata
        columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
        ids = next(c for name, c in columns.items() if name.startswith("ids"))
        assert any("DICTIONARY" in e for e in ids.encodings)
        for name in ("doc_id", "block_start", "n_tokens"):
            assert "DELTA_BINARY_PACKED" in columns[name].encodings and not any("DICTIONARY" in e for e in columns[name].encodings)
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert meta.row_group(0).total_byte_size <= 2 * token_files.ROW_GROUP_BYTES
    some = token_files.read_documents(spark, "file://" + out, [30, 4500, 5])
    assert {r.doc_id: list(r.ids) for r in some.collect()} == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in texts if i in (30, 4500)}
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    light = token_files.read_metadata(spark, "file://" + out)
    assert "ids" not in light.columns and "ids" not in light._jdf.queryExecution().executedPlan().toString()
    assert light.agg(F.sum("n_tokens")).first()[0] == sum(len(t.split()) + 1 for _, t in texts)


def test_a_word_is_looked_up_once_a_batch(library):
    class Known(dict):
        looked = 0

        def get(self, word, other=None):
            self.looked += 1
            return super().get(word, other)

        def __contains__(self, word):
            self.looked += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.looked += 1
            return super().__getitem__(word)

    own = WordBpe(vocabulary_path())
    own.known = Known()
    for texts in (["port of  call ", "", "\tport\x0bof\n"], ["of port"], ["call a port, of"]):
        before = own.known.looked
        ids, begins = own.encode_texts(texts, 1)
        assert [ids[begins[k] : begins[k + 1] - 1].tolist() for k in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert own.known.looked - before <= len({w for t in texts for w in t.split()} | {""})
