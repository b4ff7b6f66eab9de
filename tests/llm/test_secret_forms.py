"""Forms in which a random string stands in a text, and classes of characters it is made of."""

import pytest

from mixedframe.llm.secret_scan import redact_secrets, scan_secrets

KEY = "Zx9Kq3LmP0vT7wYb2NcR8sDf1GhJ4"
FOUND = [
    (f"PRIVATE_KEY={KEY}", KEY), (f"sig={KEY}&x=1", KEY), ("aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYq8Zt", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYq8Zt"),
    (f'{{"url":"https://host.org/a","key":"{KEY}"}}', KEY), (f"URL=https://host.org\nKEY={KEY}\n", KEY), (f"a@b.org,{KEY},7", KEY), (f"https://host.org/a\t{KEY}", KEY),
    (f"[https://host.org]({KEY})", KEY), (f"mail a@b.org;{KEY}", KEY),
    ("key K7QX2MZP9RT4WV8BNC3JHD6F end", "K7QX2MZP9RT4WV8BNC3JHD6F"), ("key k7qx2mzp9rt4wv8bnc3jhd6f end", "k7qx2mzp9rt4wv8bnc3jhd6f"),
    ("key KqXzMfPvRtWyBnCjHdLgSaQe end", "KqXzMfPvRtWyBnCjHdLgSaQe"), ("key qxzmfpvrtwybncjhdlgs end", "qxzmfpvrtwybncjhdlgs"), ("key QXZMFPVRTWYBNCJHDLGS end", "QXZMFPVRTWYBNCJHDLGS"),
]
SPARED = [
    f"https://host.org/{KEY}", f"https://host.org/?sig={KEY}", f"a@{KEY}", "averylongbutordinarywordwithoutdigits", "erberbeeinheitkeiter", "Donaudampfschifffahrtsgesellschaft",
    "aaaaaaaaaaaaaaaaaaaaaaaab1", "2024-01-15-2024-01-16", "--------------------------", "KEY=123e4567-e89b-12d3-a456-426614174000", f"KEY=Example{KEY}",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate([t for t, _ in FOUND] + SPARED)), "doc_id int, text string")


def test_each_form_and_class_is_found_or_spared(docs):
    got = {r.doc_id: [(s.kind, s.value) for s in r.secrets] for r in scan_secrets(docs).collect()}
    assert [got[i] for i in range(len(FOUND))] == [[("entropy", v)] for _, v in FOUND]
    assert [t for i, t in enumerate(SPARED, len(FOUND)) if got[i]] == []


def test_each_form_is_redacted(docs):
    got = {r.doc_id: r.text for r in redact_secrets(docs).collect()}
    assert [got[i] for i in range(len(got))] == [t.replace(v, "[SECRET]") for t, v in FOUND] + SPARED
