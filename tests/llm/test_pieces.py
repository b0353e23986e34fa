import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm import pieces
from tests.llm.cases import MODEL, by_id, documents, empty, texts


def _same(found):
    m = pieces.load(MODEL)
    ids, at = m.encode(found)
    for t, a, b in zip(found, at[:-1], at[1:], strict=True):
        expected = m.library.encode(t)
        assert ids[a:b].tolist() == expected, t[:80]
        assert m.decode(ids[a:b]) == m.library.decode(expected)


def test_query_rows(spark):
    m = pieces.load(MODEL)
    for row in by_id(pieces.piece_digests(documents(spark), MODEL)):
        text = (texts()[row.doc_id] or "") if row.doc_id is not None else ""
        ids = m.library.encode(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(m.library.decode(ids).encode()).hexdigest()


def test_ids_and_decoded_text(spark):
    rows = by_id(pieces.encode_pieces(documents(spark), MODEL))
    m = pieces.load(MODEL)
    assert [r.ids for r in rows if r.doc_id == 12] == [m.library.encode(texts()[12])]
    assert pieces.encode_pieces(empty(spark), MODEL).collect() == []


def test_long_words_runs_and_ties():
    random.seed(5)
    _same(["".join(random.choice("abcdefgh") for _ in range(3000)), " " * 2500, "ab" * 900, "a" * 999, "▁" * 300 + "x", "日本語" * 200, "\n \n  \n", "\x00\x01é"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁\n\té中\U0001f600<s>　Ａ\x00th1.", max_size=60), min_size=1, max_size=8))
def test_any_text(found):
    _same(found)


def test_long_words_stay_in_rounds(monkeypatch):
    """Scripts without blanks are cut where no piece crosses; only what has no cut for thousands of symbols is queued."""
    m = pieces.load(MODEL)
    queued = []
    queue = pieces.Pieces.merge_queue
    monkeypatch.setattr(pieces.Pieces, "merge_queue", lambda self, w: queued.append(w) or queue(self, w))
    random.seed(8)
    m.words.forget()
    _same(["".join(random.choice("日本語の文章は空白なしに書かれる。中文也是ภาษาไทย") for _ in range(3000)), "x9" + "".join(random.choice("etaoinshrd0123") for _ in range(2000)), "日" * 300 + "abc" * 200])
    assert not queued
    assert "".join(m.cut("日本語" * 99)) == "日本語" * 99
    _same(["ab" * 5000])
    assert [len(w) > 4096 for w in queued] == [True] * len(queued)


def test_ids_that_no_encoding_gives():
    m = pieces.load(MODEL)
    for ids in ([1, 2, 0], [200, 201, 300], [28705, 28705], [264, 198, 264], [0], [264, 1, 264]):
        assert m.decode(np.array(ids)) == m.library.decode(ids)


def test_forgotten_words_are_learnt_again(monkeypatch):
    monkeypatch.setattr(pieces.load(MODEL).words, "most", 300)
    for _ in range(3):
        _same(["one two three four five", "six seven", "one"])


def test_long_runs_do_not_pile_up():
    """Runs of 50,000 characters without a blank, each a word of its own: the memory of a worker stays flat."""
    import resource

    m = pieces.load(MODEL)
    random.seed(3)
    letters = "日本語の文章は空白なしに書かれる。中文也是ภาษาไทย"
    run = "".join(random.choice(letters) for _ in range(50_000))
    text = lambda i: str(i) + run[i:] + run[:i]
    for i in range(60):
        m.encode([text(i)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for i in range(60, 220):
        ids, _ = m.encode([text(i)])
        assert i % 100 or ids.tolist() == m.library.encode(text(i))
    assert m.words.kept < m.words.most + (2 << 20)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000  # KB
