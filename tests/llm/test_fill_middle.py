import hashlib
import re

import pytest
from pyspark.sql import functions as F

from inkstream.llm import fill_middle
from tests.llm.cases import by_id, documents, empty, plain, texts

MARKED = ["a\nb\x02c\n\x01d\x01\x02e", "\x01\x01\x02\x02\n\x02\n", "one\n", "no break", "\n\n\n", "x<P\n>y<\nS>\n<M", "has <S> in it\nand more", "a\r\nb\rc\n", "é\U0001f600\n中\n" * 300, "<\n<\n>\n" * 50]


def expected(key, text, unit=r"[^\n]*\n|[^\n]+", seed=7, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(unit, text)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, None, text
    return (n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}")


def test_rows_and_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for row in by_id(fill_middle.digest(fill_middle.fill_in_middle(documents(spark)))):
        text = (texts()[row.doc_id] or "") if row.doc_id is not None else ""
        n, form, p, m, _, out = expected(row.doc_id, text)
        assert (row.n, row.form, row.output_sha256, row.restored_sha256) == (n, form, sha(out), sha(text))
        assert (row.prefix_chars, row.middle_chars) == (p if p is None else len(p), m if m is None else len(m))
    assert fill_middle.fill_in_middle(empty(spark)).collect() == []


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 0}, {"seed": 11, "spm": 100}, {"unit": fill_middle.WORDS, "seed": 5}])
def test_parts_and_restored_text(spark, options):
    """Escape and delimiter characters within texts, markers that are cut apart, all places of the cuts."""
    rows = plain(spark, list(enumerate(t for _ in range(12) for t in MARKED)))
    found = fill_middle.fill_in_middle(rows, **options)
    found = found.withColumn("restored", fill_middle.restore(F.col("output"), F.col("form")))
    forms = set()
    for row in by_id(found):
        text = MARKED[row.doc_id % len(MARKED)]
        assert tuple(row)[1:7] == expected(row.doc_id, text, **options)
        assert row.restored == text
        forms.add(row.form)
    assert "plain" in forms and len(forms) > 1


def test_no_python_and_no_shuffle(spark):
    plan = fill_middle.digest(fill_middle.fill_in_middle(documents(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_markers_that_cannot_be_told_apart(spark):
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(documents(spark), markers=markers)
