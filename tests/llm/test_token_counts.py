import base64

import numpy as np
import pytest
from tokenizers import Tokenizer

from inkstream.llm import token_counts as tc
from inkstream.llm.queries import tokenizer
from tests.llm.cases import RANKS, by_id, documents, empty, texts


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def brute(spans, ends, rule):
    """Tokens by section, a byte at a time; spans are disjoint byte ranges, sorted."""
    out, outside, crossing, start = [0] * len(spans), 0, 0, 0
    pieces, at = [], 0
    for k, (a, b) in enumerate(spans):
        pieces += [(at, a, -1), (a, b, k)]
        at = b
    pieces.append((at, max([at, *ends]), -1))
    pieces = [p for p in pieces if p[1] > p[0]]
    for end in ends:
        share = [sum(a <= x < b for x in range(start, end)) for a, b, _ in pieces]
        met = [i for i, n in enumerate(share) if n]
        i = met[0] if rule == "first" else met[-1] if rule == "last" else share.index(max(share))
        crossing += len(met) > 1
        if pieces[i][2] < 0:
            outside += 1
        else:
            out[pieces[i][2]] += 1
        start = end
    return out, outside, crossing


def token_ends(text):
    return tc.load(RANKS).ends(text).tolist()


def test_counts_by_offsets_of_another_encoder(spark, reference):
    for row in by_id(tc.section_tokens(documents(spark), RANKS, rules=tc.RULES)):
        text = (texts()[row.doc_id] or "") if row.doc_id is not None else ""
        offsets = reference.encode(text, add_special_tokens=False).offsets
        assert row.n_tokens == len(offsets) == sum(s.first for s in row.sections) and row.n_outside == 0
        assert "".join(text[s.start : s.stop] for s in row.sections) == text
        if len(text) < 2000:
            byte = lambda n, text=text: len(text[:n].encode())
            spans = [(byte(s.start), byte(s.stop)) for s in row.sections]
            for rule in tc.RULES:
                assert ([s[rule] for s in row.sections], 0, row.n_crossing) == brute(spans, token_ends(text), rule)
    assert tc.section_tokens(empty(spark), RANKS).collect() == []


SPANNED = [
    ("Ünïcode 日本語 words, and more 日本語", [(0, 9), (9, 13), (20, 99)]),
    ("日本語日本語日本語 ÄÖÜ", [(5, 7), (1, 3), (2, 6)]),
    ("plain words only", []),
    ("plain words only", None),
    ("", [(0, 4)]),
    (None, [(0, 4)]),
    ("abc def", [(4, 2), (-3, 2), (3, 3), (None, 4)]),
    ("emoji \U0001f600\U0001f601 x" * 20, [(7, 8), (8, 60)]),
]


def test_spans_of_characters(spark):
    rows = [(i, t, s) for i, (t, s) in enumerate(SPANNED)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<a:int,b:int>>")
    for row in by_id(tc.section_tokens(df, RANKS, rules=tc.RULES, spans="parts")):
        text, said = SPANNED[row.doc_id]
        text = text or ""
        owner = {}
        for k, (a, b) in enumerate(sorted((a, b) for a, b in said if a is not None) if said is not None else [(0, len(text))]):
            for x in range(max(a, 0), min(b, len(text))):
                owner.setdefault(x, k)
        kept = [[x for x in range(len(text)) if owner.get(x) == k] for k in range(len(row.sections))]
        for s, k in zip(row.sections, kept, strict=True):
            assert list(range(s.start, s.stop)) == k
        byte = lambda n, text=text: len(text[:n].encode())
        spans = [(byte(s.start), byte(s.stop)) for s in row.sections]
        for rule in tc.RULES:
            counts, outside, crossing = brute(spans, token_ends(text), rule)
            assert [s[rule] for s in row.sections] == counts and row.n_crossing == crossing
            if rule == "first":
                assert row.n_outside == outside


def test_fields_make_up_the_document(spark):
    found = [(1, "Ein Titel", "Text 日本語", 5), (2, None, "x", None), (3, "", "", 0)]
    df = spark.createDataFrame(found, "doc_id long, title string, body string, n int")
    for row, (_, *fields) in zip(by_id(tc.field_tokens(df, RANKS, ("title", "body", "n"), separator="\n")), found, strict=True):
        parts = ["" if f is None else str(f) for f in fields]
        parts = [p + "\n" for p in parts[:-1]] + parts[-1:]
        edges = [0]
        for p in parts:
            edges.append(edges[-1] + len(p.encode()))
        assert (row.tokens, 0, row.n_crossing) == brute(list(zip(edges, edges[1:], strict=False)), token_ends("".join(parts)), "first")
        assert sum(row.tokens) == row.n_tokens


def test_rules_for_tokens_that_cross():
    ends, bounds = np.array([3, 8, 10, 20]), np.array([4, 6, 12, 20])
    assert tc.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 2, 0]
    assert tc.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2, 1]
    assert tc.attribute(ends, bounds, "most")[0].tolist() == [1, 1, 1, 1]
    assert tc.attribute(ends, bounds)[1].sum() == 2
    with pytest.raises(ValueError):
        tc.attribute(ends, bounds, "half")
    wide = np.array([2, 3, 9, 12, 30])
    assert tc.attribute(np.array([30]), wide, "most")[0].tolist() == [0, 0, 0, 0, 1]
    assert tc.attribute(np.array([1, 10]), wide, "most")[0].tolist() == [1, 0, 1, 0, 0]


def test_the_split_pattern_is_that_of_the_rank_file():
    import public_tokenizers

    assert tc.PATTERN == public_tokenizers.PATTERN
    with open(RANKS, "rb") as f:
        first = f.readline().split()
    assert tc.load(RANKS).size[int(first[1])] == len(base64.b64decode(first[0]))
