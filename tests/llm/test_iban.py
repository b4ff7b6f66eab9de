"""Account numbers with other words around them."""

from mixedframe.llm.pii import IBAN_LENGTHS, find_personal_data

DE, GB, NO, MT = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"
TEXTS = {
    f"{DE} BIC COBADEFFXXX": [DE], f"{DE} Thanks": [DE], "DE89 3704 0044 0532 0130 00 Amount": ["DE89 3704 0044 0532 0130 00"], f"{DE} EUR 100": [DE],
    f"{DE} {GB} {NO} 7": [DE, GB, NO], f"{MT} A": [MT], f"IBAN {DE}.": [DE], f"iban {DE} ok": [DE], "DE12 " + DE: [DE],
    "DE89370400440532013001 EUR": [], f"{DE}A": [], f"x{DE}": [], f"{DE[:-1]} ": [], "AB12 3456 7890 1234 567": [],
}


def test_account_numbers_end_where_their_country_says(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: [s.value for s in r.personal if s.kind == "iban"] for r in find_personal_data(docs).collect()}
    assert [got[i] for i in range(len(TEXTS))] == list(TEXTS.values())


def test_each_country_has_one_length():
    countries = " ".join(IBAN_LENGTHS.values()).split()
    assert len(countries) == len(set(countries)) and all(len(c) == 2 for c in countries)
