import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.llm import secrets as s
from tests.llm.cases import by_id, documents, empty, plain, texts


def either(word):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda x: (x[0], x[2]))


PARTS = ["password", "PassWd", "token", "secret", "api_key", "APIKEY", ":", "=", " ", '"', "'", "AKIA", "AKIA0123456789ABCD", "0123456789abcdef", "deadbeef", "é", "ſecret", "K", "Abc/+=-_.", "\n", "abcDEF123", "."]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_spans(text):
    assert [x[:3] for x in s.candidates(text) if x[2] < 3] == base(text)


def test_query_rows(spark):
    rows = by_id(s.digest(s.scan_secrets(documents(spark))))
    assert len(rows) == len(texts()) + 3
    for row in rows:
        text = (texts()[row.doc_id] or "") if row.doc_id is not None else ""
        expected = base(text)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == i for _, _, k in expected) for i in range(3)]
        said = [x for x in row.spans.split(",") if x and not x.startswith("live")]
        assert said == [f"{s.KINDS[k]}:{a}:{b}" for a, b, k in expected]
    assert s.digest(s.scan_secrets(empty(spark))).collect() == []


def test_ownership_tells_examples_from_credentials(spark):
    example, own = "x9Kq2LmW7vRt4ZpY8sNd3HfG6bTc", "b7Jw5QxE1kUo9MzA4rVi2PsD8nGh"
    docs = plain(spark, [(i, f"say {example} now") for i in range(6)] + [(10, f"mine {own} here"), (13, f"again {own}")])
    rows = by_id(s.digest(s.scan_secrets(docs)))
    assert [r.n_live for r in rows] == [0] * 6 + [1, 1]
    assert [r.n_owner_specific for r in rows] == [0] * 6 + [1, 1]
    kept = {r.doc_id: r.text for r in s.mask_secrets(docs).collect()}
    assert kept[0] == f"say {example} now" and kept[10] == "mine [live] here"


def test_many_shared_values(spark, monkeypatch):
    docs = plain(spark, [(i, f"say x9Kq2LmW7vRt4ZpY8sNd3HfG6bTc and b7Jw5QxE1kUo9MzA4rVi2PsD8n{i // 4}Gh") for i in range(24)])
    before = by_id(s.digest(s.scan_secrets(docs)))
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(s, "HOT_REPOS", 10)
    assert by_id(s.digest(s.scan_secrets(docs))) == before and [r.n_live for r in before] == [0] * 24


def test_masking_takes_every_base_span_and_nothing_else(spark):
    docs = documents(spark)
    masked = s.mask_secrets(docs, length="n_chars")
    assert masked.columns == docs.columns
    rows = {r[0]: r for r in masked.collect()}
    assert rows[12][1] == '[assign]" and [access]'
    assert rows[12][4] == len(rows[12][1])
    for i, t in enumerate(texts()):
        if not s.candidates(t or ""):
            assert rows[i][1] == t
        else:
            assert not base(rows[i][1])


def test_overlapping_spans_go_together():
    assert s.mask("abcdefghij", [(1, 4, 0), (3, 6, 2), (8, 9, 1)]) == "a[assign]gh[access]j"


def test_many_repositories_of_one_owner_are_copies(spark, monkeypatch):
    monkeypatch.setattr(s, "LIVE_REPOS", 4)
    example, own = "x9Kq2LmW7vRt4ZpY8sNd3HfG6bTc", "b7Jw5QxE1kUo9MzA4rVi2PsD8nGh"
    docs = plain(spark, [(3 * i, f"say {example}") for i in range(5)] + [(100 + 3 * i, f"mine {own}") for i in range(4)])
    rows = by_id(s.digest(s.scan_secrets(docs)))
    assert [r.n_live for r in rows] == [0] * 5 + [1] * 4


def test_an_opaque_string_with_a_base_span_inside_is_masked_whole(spark):
    key = "x9Kq2LmW7vRt4ZpY8sNd3H" + "0123456789abcdef" + "Q7Jw5QxG1kUz9MzA4rViZP"
    assert [x[:3] for x in s.candidates(key)] == [(0, 60, 3), (22, 38, 2)]
    assert [x[2] for x in s.candidates("0123456789abcdef" * 3)] == [2]
    assert s.mask_secrets(plain(spark, [(1, f"a {key} b")])).first().text == "a [live] b"


def test_base_spans_are_judged_by_their_owners_as_well(spark):
    """A password that several sources show is a copied example, one of a single source looks live; both stay."""
    example, own = "correct-horse-battery", "q7Zk2LmX9vRt4WpY8"
    docs = plain(spark, [(i, f'password = "{example}"') for i in range(3)] + [(9, f'password = "{own}" and token: {example}'), (10, "nothing")])
    rows = {r.doc_id: r for r in s.digest(s.scan_secrets(docs)).collect()}
    assert [rows[i].verdicts for i in (0, 1, 2, 9, 10)] == ["copied", "copied", "copied", "live,copied", ""]
    assert [(rows[i].n_assign, rows[i].n_owner_specific, rows[i].n_widely_copied) for i in (0, 9)] == [(1, 0, 1), (2, 1, 1)]
