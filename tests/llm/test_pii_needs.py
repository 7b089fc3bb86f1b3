"""Wider candidates of personal data do not depend on unrelated characters elsewhere in the text."""

from tessella.llm import pii


def test_wide_candidates_need_only_their_own_characters(spark):
    texts = ["call 555.123.4567 now", "mail user [AT] site [DOT] com", "mail user (At) site.com", "call (555)123.4567", "id 123-45-6789", "none here"]
    rows = [(i, t + more) for i, t in enumerate(texts) for more in ("", " - at @")]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "wide.kind", "wide.start", "wide.stop").collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r["doc_id"], []).append((r["kind"], r["start"], r["stop"]))
    assert all(a == b for a, b in kinds.values())
    assert [kinds[i][0][0] for i in range(6)] == [["phone_local"], ["email_spelled"], ["email_spelled"], ["phone_local"], ["national_id"], []]
