import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkstream.llm import byte_pairs, words
from inkstream.llm.queries import tokenizer
from tests.llm.cases import by_id, documents, empty, texts

MULTI, JSON = tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer("byte_bpe_50k.json")


def _library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=byte_pairs.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = Tokenizer.from_file(JSON)
    other.encode_special_tokens = True
    return encoding.encode_ordinary, lambda t: other.encode(t, add_special_tokens=False).ids


RANKED, MERGED = _library()


def _same(found):
    for path, library in ((MULTI, RANKED), (JSON, MERGED)):
        m = byte_pairs.load(path)
        ids, at = m.encode(found)
        for t, a, b in zip(found, at[:-1], at[1:], strict=True):
            assert ids[a:b].tolist() == library(t), t[:80]
            assert m.decode(ids[a:b]).tobytes() == t.encode()


def test_query_rows(spark):
    for row in by_id(byte_pairs.byte_digests(documents(spark), MULTI)):
        text = (texts()[row.doc_id] or "") if row.doc_id is not None else ""
        ids = RANKED(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_and_decoded_bytes(spark):
    rows = by_id(byte_pairs.encode_bytes(documents(spark), MULTI))
    assert [(r.ids, bytes(r.decoded)) for r in rows if r.doc_id == 12] == [(RANKED(texts()[12]), texts()[12].encode())]
    assert byte_pairs.encode_bytes(empty(spark), MULTI).collect() == []


def test_every_bucket_and_the_queue(monkeypatch):
    random.seed(4)
    queued = []
    queue = byte_pairs.BytePairs.merge_queue
    monkeypatch.setattr(byte_pairs.BytePairs, "merge_queue", lambda self, p: queued.append(len(p)) or queue(self, p))
    sizes = sorted({w + d for w in byte_pairs.WIDTHS for d in (-1, 0, 1)})
    _same(["".join(random.choice(alphabet) for _ in range(n)) for n in sizes for alphabet in ("ab", "etaoins", "éß中日本語", "0123456789", "=-#")])
    assert all(n > byte_pairs.WIDTHS[-1] for n in queued)
    _same(["q" * 20_000, "ab" * 3_000, "".join(random.choice("abcdefgh") for _ in range(5_000))])
    assert max(queued) >= 5_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab ▁\n\t\ré中\U0001f600'st　\x00\x1c\x8519.<|endoftext|>", max_size=60), min_size=1, max_size=8))
def test_any_text(found):
    _same(found)


def test_characters_that_the_library_does_not_know_yet():
    """The pattern library may follow a later Unicode than the tokenizer's; letters only it knows are no letters here."""
    m = byte_pairs.load(MULTI)
    random.seed(1)
    some = random.sample(sorted(m.later), min(len(m.later), 200)) or ["x"]
    known = random.sample([chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000], 400)
    _same(["".join(random.choice("ab1 !\n'" + "".join(random.sample(some, 5)) + "".join(random.sample(known, 5))) for _ in range(60)) for _ in range(200)])


def test_colliding_pairs_are_found():
    left, right = np.repeat(np.arange(60, dtype=np.int32), 60), np.tile(np.arange(60, dtype=np.int32), 60)
    table = byte_pairs.PairRanks(left, right, np.arange(3600, dtype=np.int32), 100)
    clash = byte_pairs.PairRanks.__new__(byte_pairs.PairRanks)
    assert table.of(left, right).tolist() == list(range(3600))
    assert (table.of(left + 60, right) == np.iinfo(np.int32).max)[1:].all()
    clash._spot = lambda key: np.full(key.shape, 3)  # all in one slot
    clash.__init__(left[:50], right[:50], np.arange(50, dtype=np.int32), 100)
    assert clash.of(left[:60], right[:60]).tolist() == [*range(50), *[np.iinfo(np.int32).max] * 10]


def test_kept_words_are_bounded_in_bytes(monkeypatch):
    """Runs without blanks are words of a text's own: thousands of them must not pile up in a worker."""
    m = byte_pairs.BytePairs.__new__(byte_pairs.BytePairs)
    m.__dict__.update(byte_pairs.load(MULTI).__dict__)
    m.words = words.KnownWords(m.encode_parts, most=1 << 20)
    kept = []
    for i in range(60):
        text = hashlib.sha512(str(i).encode()).hexdigest() * 400
        ids, _ = m.encode([text])
        kept.append(m.words.kept)
        assert i % 20 or ids.tolist() == RANKED(text)
    assert max(kept) < 2 << 20


def test_vocabularies_without_all_bytes_are_refused():
    with pytest.raises(ValueError, match="no token for the bytes"):
        byte_pairs.BytePairs([b"a"], (np.zeros(0, np.int32),) * 4, {}, lambda c: True)
