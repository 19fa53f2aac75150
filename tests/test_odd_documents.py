"""Queries on documents that the test tables do not hold, against their twins in SQL."""

import pytest

from lorewright.plans.registry import ORACLE, QUERIES

from .oracle import assert_same, connected


@pytest.fixture
def against_sql(spark, tmp_path):
    def check(name, texts, first=1):
        rows = [(first + i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").toPandas().to_parquet(tmp_path / "documents.parquet")
        assert_same(QUERIES[name](spark, str(tmp_path)), connected(str(tmp_path)), ORACLE[name])

    return check


def test_texts_without_words_have_no_first_shingle(against_sql):
    against_sql("str_shingles", ["", "!?", "a b", "7", "word", "two words", None])


#: Values behind and before letters, digits and white space that are not ASCII, and a null text.
PERSONAL = [
    "größe ämy@mail.org, xüann@x.org and éDE89370400440532013000 or 中4111111111111111",
    "öghp_" + "c" * 36 + "ß and ٣sk-" + "b1" * 12 + "ü",
    "password: one two, token=a b;PIN: １２３４ secret=x\u0085y, paſſword: hunter22, toKen: abcdef, pın: 12345",
    "١٢٣٤٥٦٧٨٩٠١٢٣ and 0٣٣٣٣٣٣٣ and ä0171 234567, 0171 234568",
    None,
    "",
]


@pytest.mark.parametrize("name", ["sec_pii", "sec_pseudonyms"])
def test_personal_data_between_letters_of_all_kinds(against_sql, name):
    against_sql(name, PERSONAL)


#: Values that come first where no pattern finds them, that overlap in chains, that one character alone divides, PEM keys and long ones.
SEARCHED = [
    "x4111111111111111 4111111111111111 and x4111111111111111",
    "0171 234567,0171 234568;0171 234569, 0171 234567",
    "-----BEGIN RSA PRIVATE KEY-----" + "k" * 40 + "-----END RSA PRIVATE KEY-----",
    "eyJ" + "a" * 1500 + ".eyJ" + "b" * 12 + "." + "c" * 12 + " eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 1500,
    "MT84MALT011000012345MTLCAST001S 4111111111111111@mail.example.org",
    "pin: 4111111111111111-0171 234567@x.org token=abc 030/1234567",
    "token=sk-" + "a1" * 12 + " ask, pwd: sk-" + "a1" * 12,
]


@pytest.mark.parametrize("name", ["sec_pii", "sec_pseudonyms"])
def test_personal_data_is_found_as_a_search_finds_it(against_sql, name):
    against_sql(name, SEARCHED)


def test_names_of_overlapping_finds_are_written_as_in_the_sql():
    from lorewright.operators.secure import pseudonyms

    finds = lambda text: [("card", 1, 4, "bcd"), ("card", 3, 6, "def")]
    assert pseudonyms("abcdefg", finds)[0] == "a[CARD-1]d[CARD-2]g"
