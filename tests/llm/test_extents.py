"""What a match of a pattern takes, and what follows it."""

import pytest

from lodevec.llm import pii


@pytest.fixture(scope="module")
def rewritten(spark):
    def run(*texts):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [(r.text, [x.kind for x in r.pii_found]) for r in pii.pseudonymised(docs).orderBy("doc_id").collect()]

    return run


def test_check_digits_choose_the_extent(rewritten):
    iban, spaced, card, amex = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "4111111111111111", "3782 822463 10005"
    (new, _), (new_spaced, _), (new_card, _), (new_amex, _), (mail, _) = rewritten(iban, spaced, card, amex, "mo.li@example.org")
    assert iban != new and spaced != new_spaced and card != new_card and amex != new_amex
    cases = [
        (f"{iban} BIC COBADEFFXXX", f"{new} BIC COBADEFFXXX", ["iban"]),
        (f"to {iban} EUR 500 paid", f"to {new} EUR 500 paid", ["iban"]),
        (f"{spaced} REF 7", f"{new_spaced} REF 7", ["iban"]),
        (f"{iban} {card}.", f"{new} {new_card}.", ["iban", "number"]),
        (f"{iban} {iban} {spaced}", f"{new} {new} {new_spaced}", ["iban"] * 3),
        (f"{iban} MO mo.li@example.org", f"{new} MO {mail}", ["iban", "email"]),
        (f"AB12 CODE 9 {iban}", f"AB12 CODE 9 {new}", ["iban"]),
        (f"DE88370400440532013000 {card}", f"DE88370400440532013000 {new_card}", ["number"]),
        (f"card {card} 123", f"card {new_card} 123", ["number"]),
        (f"card 123 {card}", f"card 123 {new_card}", ["number"]),
        (f"\U0001f600 {amex} 99\né", f"\U0001f600 {new_amex} 99\né", ["number"]),
    ]
    assert rewritten(*(c[0] for c in cases)) == [c[1:] for c in cases]
