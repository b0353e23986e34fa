import bisect
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstream.llm import alignment, byte_pairs, pieces
from inkstream.llm.queries import tokenizer
from tests.llm.cases import MODEL, by_id, documents, empty, plain, texts
from tests.llm.test_byte_pairs import MERGED

JSON = tokenizer("byte_bpe_50k.json")
BACK = byte_pairs.byte_of_char()


NAMES = {i: s for s, i in Tokenizer.from_file(JSON).get_vocab(with_added_tokens=False).items()}


def _tokens(text):
    """(id, bytes) of A and of B, by the libraries; none where they do not spell the text."""
    library = pieces.load(MODEL).library
    a = [(i, bytes(BACK[c] for c in NAMES[i])) for i in MERGED(" " + text)]
    b = []
    for i in library.encode(text):
        p = library.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def expected(found):
    """Rows by the definition: cuts where tokens of both end, all pairs of a group, counts by document."""
    docs, held = [], defaultdict(set)
    for row, text in enumerate(found):
        a, b = _tokens(text) if text else ([], [])
        ends_a, ends_b = (list(itertools.accumulate(len(x) for _, x in side)) for side in (a, b))
        cuts = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in cuts]
        for side, (tokens, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for (i, _), e in zip(tokens, ends, strict=True):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = Counter(p for x, y in groups for p in itertools.product(x, y))
        for p in links:
            held[p].add(row)
        docs.append((len(a), len(b), groups, links))
    count = {p: len(rows) for p, rows in held.items()}
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in docs:
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for p, n in links.items() if count[p] == best[p[0]])
        out.append((n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * count[p] for p, n in links.items()), hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return out


ODD = ["nothing odd", "a ▁ b", "<|endoftext|> and </s>", "  two  blanks ", "日本語の文章", "é\U0001f600é", "a" * 300, "\x00\x01", "unaligned1234567890antidisestablishmentarianism", "x\n\ny\t z"]


@pytest.fixture(scope="module")
def rows():
    random.seed(2)
    words = "the of river Stone stones 2024 naïve don't re-read,日本 qzx\n  indivisibility's".split(" ")
    return [None, "", *ODD, *ODD[:3], *[" ".join(random.choice(words) for _ in range(40)) for _ in range(30)]]


def test_rows_by_the_definition(spark, rows):
    found = by_id(alignment.link_digests(plain(spark, list(enumerate(rows))), JSON, MODEL))
    assert [tuple(r)[1:] for r in found] == expected(rows)


def test_odd_documents(spark):
    found = alignment.link_digests(documents(spark), JSON, MODEL).collect()
    given = [*texts(), texts()[6], texts()[3], None]
    assert Counter(tuple(r)[1:] for r in found) == Counter(expected(given))
    assert sum(r.doc_id is None for r in found) == 1
    assert alignment.link_digests(empty(spark), JSON, MODEL).collect() == []


@pytest.mark.parametrize("most", [0, 20, 10**6])
def test_broadcast_and_shuffle_agree(spark, rows, most):
    """No pair broadcast, some, or all: the same sums."""
    linked = alignment.linked_texts(plain(spark, list(enumerate(rows))), JSON, MODEL)
    counts = alignment.count_pairs(linked)
    got = {r.doc_id: (r.n_best, r.count_sum) for r in linked.join(alignment.weigh_links(linked, counts, most), "_row").select(F.col("key").alias("doc_id"), "n_best", "count_sum").collect()}
    assert got == {i: x[4:6] for i, x in enumerate(expected(rows)) if x[3]}


def test_tokens_with_ends_and_groups(spark):
    (row,) = alignment.align_tokens(plain(spark, [(0, "re-reading stones")]), JSON, MODEL).collect()
    (a, b) = _tokens("re-reading stones")
    assert (row.a_ids, row.b_ids) == ([i for i, _ in a], [i for i, _ in b])
    assert row.a_ends == list(itertools.accumulate(len(x) for _, x in a))
    for g in range(max(row.a_groups) + 1):
        assert max(e for e, x in zip(row.a_ends, row.a_groups, strict=True) if x == g) == max(e for e, x in zip(row.b_ends, row.b_groups, strict=True) if x == g)


def test_union_find_on_random_graphs():
    random.seed(6)
    for n in (1, 2, 5, 200):
        for m in (0, 1, n // 2, n, 3 * n):
            edges = np.array([(random.randrange(n), random.randrange(n)) for _ in range(m)], np.int64).reshape(-1, 2)
            label = list(range(n))
            for _ in range(n):
                for x, y in edges.tolist():
                    label[x] = label[y] = min(label[x], label[y])
            assert alignment.union_find(n, edges[:, 0], edges[:, 1]).tolist() == label
    chain = np.random.default_rng(1).permutation(5000)
    assert (alignment.union_find(5000, chain[:-1], chain[1:]) == 0).all()


def test_large_groups_expand_distinct_ids(monkeypatch):
    """A group counts all its token pairs, but only its distinct ids are expanded."""
    text = ["".join(random.Random(3).choice("aé中") for _ in range(400)), "b" * 3000, "plain words"]
    f, g = byte_pairs.load(JSON), pieces.load(MODEL)
    all_ids = [x.tolist() for x in alignment.Aligned(text, f, g).pairs()]
    monkeypatch.setattr(alignment, "GROUP_LINKS", 0)
    distinct = alignment.Aligned(text, f, g)
    assert [x.tolist() for x in distinct.pairs()] == all_ids
    assert np.bincount(distinct.pairs()[0], weights=distinct.pairs()[3]).tolist() == distinct.links().tolist()
