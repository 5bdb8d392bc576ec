"""Token ids, token files and packing against the library called on whole texts."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillgrid.llm import packing, token_files
from tillgrid.llm.tokens import PartEncoder, tokenizer_path
from tillgrid.session import shared_dir

FILES = {"words": "word_bpe_49k.json", "spaced": "byte_bpe_50k.json"}
TEXTS = ["", " ", "\n", "a", " a  b \n\n c ", "It's we'll o'clock 'S '' '", "x" * 300, "1234 5.6e7 A1b2", "naïve Ünïcode ſharp İstanbul ŉ",
         "tab\there", "nbsp x", "日本語 テスト", "é ́a", "<|endoftext|> <|startoftext|>", "ΑΣ ΟΔΟΣ.", "a\r\nb", "\u0085x", "²½ _x_ --", "😀 ok"]


def whole(form):
    tok = Tokenizer.from_file(tokenizer_path(FILES[form]))
    return lambda t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("form", FILES)
def test_parts_give_the_ids_of_the_whole_text(form):
    enc, ref = PartEncoder.load(tokenizer_path(FILES[form]), form), whole(form)
    texts = [*TEXTS, " ".join(TEXTS), "\n".join(TEXTS)]
    for batch in (texts, *([t] for t in texts), []):
        ids, counts = enc.encode(batch, 7)
        want = [[*ref(t).tolist(), 7] for t in batch]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w], batch


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n'sStTrReEléÉß09.,_-!\t ́Σσ"), st.characters(codec="utf-8")), max_size=40),
       st.sampled_from(["", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"]), st.integers(0, 40))
def test_any_text(t, added, at):
    t = t[:at] + added + t[at:]
    for form in FILES:
        assert PartEncoder.load(tokenizer_path(FILES[form]), form).encode([t], 0)[0].tolist() == [*whole_cached(form)(t).tolist(), 0]


@functools.cache
def whole_cached(form):
    return whole(form)


SCHEMA = "doc_id long, text string, piece string, tokens string, length string"
ROWS = [(3, "b " * 3000, "x", None, "y"), (1, None, None, None, None), (2, "", "", "", ""), (None, "null id", None, None, None), (5, "same", "", "", ""),
        (5, "same", "", "", ""), (4, "a b c", None, None, None)]


def test_pack_documents(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.pack_documents(docs, tokenizer_path(FILES["words"]), 0).toPandas()
    ref = whole("words")
    want = []
    for d, t, *_ in ROWS:
        ids = np.append(ref(t or ""), np.uint32(0)).astype("<u4")
        want += [(d, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(ids[i:i + 2048].tobytes())) for i in range(0, len(ids), 2048)]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.length.cumsum() - g.length == g.offset).all()


def test_sum_of_squares_against_plain_search():
    lengths = np.random.default_rng(1).integers(1, 21, 400)
    bins, offsets = packing.sum_of_squares(lengths, 20)
    gaps, where = [], []
    for s in lengths.tolist():
        def score(gap):
            after = [*gaps, 20]
            after[after.index(gap) if gap < 20 else -1] = gap - s
            counts = np.bincount([g for g in after if 0 < g < 20], minlength=21)
            return int((counts ** 2).sum()), gap
        gap = min((score(g) for g in {*(g for g in gaps if s <= g), 20}))[1]
        where.append(20 - gap)
        gaps = [*gaps, 20] if gap == 20 else gaps
        gaps[gaps.index(gap)] = gap - s
    assert where == offsets.tolist() and len(gaps) == bins.max() + 1


def test_token_files_round_trip(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    path = shared_dir(spark, "tok")
    token_files.write_tokens(token_files.encode_documents(docs, tokenizer_path(FILES["spaced"]), 2, file_text_bytes=1000), path)
    ref, start = whole("spaced"), 0
    want = []
    for d, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(ref(t or ""), np.uint32(2)).astype("<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.token_digests(spark, path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    meta = token_files.read_metadata(spark, path)
    assert sorted((r.start, r.n_tokens) for r in meta.collect()) == [w[1:3] for w in want]
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString()
    picked = token_files.read_tokens(spark, path, 4, 4).collect()
    assert [r.tokens for r in picked] == [[*ref("a b c").tolist(), 2]]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(docs, tokenizer_path(FILES["words"]), 0).count() == 0
    path = shared_dir(spark, "tok")
    token_files.write_tokens(token_files.encode_documents(docs, tokenizer_path(FILES["spaced"]), 2), path)
    assert token_files.token_digests(spark, path).count() == 0
