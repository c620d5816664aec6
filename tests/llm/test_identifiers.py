"""Identifiers of unseen form beside others, in long runs of numbers, with a written-out at sign, and long ones."""

from runlens.llm import pii

CALLS = [(i, f"notes {i} please dial number +1 (555) 010-{1000 + i} before noon and go") for i in range(12)]
LINES = [(20 + i, f"office {i} contact u{i}@example.com +1 (555) 020-{1000 + i} thanks") for i in range(12)]
MAILS = [(i, f"note {i} write to {'u' * (i % 3)}user{i}@example.com today") for i in range(12)]


def marked(spark, rows):
    texts = dict(rows)
    found = pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: [texts[r["doc_id"]][int(a) : int(b)] for _, a, b in (s.split(":") for s in r["spans"].split(",") if s)] for r in found}


def test_each_of_neighbouring_identifiers_is_found(spark):
    more = [
        (50, "office contact x.y@example.com 555-777-8899 thanks"), (51, "please dial number (555) 777-8899 24 hours a day"),
        (52, "please dial number (555) 777-8899 24 1234 5678 9012 3456 7890 1234 77 and"), (53, "please dial number 555  777 8899 now"),
    ]
    found = marked(spark, CALLS + LINES + more)
    assert found[50] == ["x.y@example.com", "555-777-8899"]
    assert found[51] == ["(555) 777-8899"] and found[52] == ["(555) 777-8899"] and found[53] == ["555  777 8899"]
    assert all(len(found[i]) == 1 for i, _ in CALLS) and all(len(found[i]) == 2 for i, _ in LINES)


def test_written_out_at_signs_are_found(spark):
    name = "j" * 60
    more = [(50, "write to jane (at) example.com today"), (51, "write to jane[at]example.com today"), (52, f"write to {name}[at]example.com today"),
            (53, "we look (at) things")]
    found = marked(spark, MAILS + more)
    assert found[50] == ["jane (at) example.com"] and found[51] == ["jane[at]example.com"] and found[52] == [f"{name}[at]example.com"]
    assert found[53] == []


def test_long_addresses_are_seeds(spark):
    rows = [(i, f"please reach {'name' * 12}{i}@example.com soon") for i in range(12)] + [(50, "please reach jane[at]example.com soon")]
    assert marked(spark, rows)[50] == ["jane[at]example.com"]


def test_long_texts_take_linear_time():
    for part in ("a", "a@", "(at)", "1.", "a(at)", "+1 "):
        pii.mentions(part * 20_000, pii.base_spans(part * 20_000))
