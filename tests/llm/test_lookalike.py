import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.llm import confusables
from reviewloom.llm import lookalike as la
from reviewloom.llm import q_lookalike

from .helpers import TRICKY, table, tuples

CASES = {
    "Тhe сolour": "The colour", "ＱＤ１１２８收到": "QD1128收到", "够⽤三天": "够用三天", "café": "café", "a​b‍c­は": "abcは", "a b　c d": "a b c d", "𝗴𝗼𝗼𝗱 𝐃𝐚𝐲": "good Day", "好👨‍👩‍👧了": "好👨‍👩‍👧了", "❤️好": "❤️好", "Качество хуже": "Качество хуже",
    "кaчество": "качество", "，。！～＠１": "，。！～＠1", "①②℃™": "①②℃™", "a\tb\nc": "a\tb\nc", "": "", "naïve É": "naïve É", "Μοdel": "Model", "Αθήνα": "Αθήνα",
}


@pytest.mark.parametrize("text", CASES)
def test_form(text):
    assert la.consistent_form(text) == CASES[text]
    assert la.consistent_form(CASES[text]) == CASES[text]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aеοＡ１⽤é́​‍️👩❤ 　кт好，𝐚-"), st.characters(exclude_categories=["Cs"])), max_size=30))
def test_idempotent(text):
    once = la.consistent_form(text)
    assert la.consistent_form(once) == once


#: Look-alikes beyond Cyrillic and Greek, by the public table.
ALIKE = [("օnly", "only"), ("pɑy", "pay"), ("Ꭺpple", "Apple"), ("ꓮpple", "Apple"), ("ⅼook", "look"), ("modern", "modem"), ("G00D", "GOOD"), ("1ove", "love"), ("Іvan", "Ivan"), ("ɡood", "good")]


def test_skeletons_are_those_of_the_public_table():
    assert all(la.skeleton(a) == la.skeleton(b) for a, b in ALIKE)
    assert [la.consistent_form(a) for a, _ in ALIKE[:5]] == [b for _, b in ALIKE[:5]] and la.consistent_form("G00D modern") == "G00D modern"
    assert la.skeleton("good") != la.skeleton("goad") and len(confusables.table().prototypes) > 6000


def test_words_truly_of_another_alphabet_stay():
    for text in ("Հայաստան", "Αθήνα και Kestra", "год good", "нос и рот у Kestra", "ᏣᎳᎩ", "[ɑː]", "ночь"):
        assert la.consistent_form(text) == text
    # A word that could be either goes with the text's other words.
    assert la.consistent_form("у нас гoрe") == "у нас горе" and la.consistent_form("the рrice") == "the price"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcopxyAEHKaеосрхуԛΑΕΗοраｅօɑ ", max_size=20))
def test_a_text_and_its_form_have_one_skeleton(text):
    assert la.skeleton(text) == la.skeleton(la.consistent_form(text))


def test_skeleton():
    assert la.skeleton("Тhe") == la.skeleton("The") == la.skeleton("Ｔhe") != la.skeleton("Tha")


def test_tables(spark):
    df = table(spark, [*TRICKY, (20, "Тhe"), (21, "The"), (21, "The"), (22, "ｔhe")], "record bigint, text string")
    assert tuples(la.changed_ids(df, "record", "text"), "record_id") == [(20,), (22,)]
    got = la.normalized(df, "record", "text")
    assert got.count() == df.count() and got.where("changed").count() == 2 and got.where("text IS NULL").first()["consistent"] is None
    groups = la.look_alike_groups(df, "record", "text").collect()
    assert [(g["variants"], g["records"], g["first_id"]) for g in groups] == [(2, 3, 20)]
    assert la.changed_ids(df.where("false"), "record", "text").count() == 0


def test_groups_of_both_fields(spark, tmp_path):
    """Groups of the second field and groups across the fields come out as well; ids are each field's own."""
    reviews = [(1, "The end"), (2, "Тhe end"), (2, "Тhe end"), (3, "good"), (4, "alone"), (5, None), (6, "same"), (None, "ａll"), (7, "")]
    analyses = [(1, "The end"), (8, "G00D"), (7, "GOOD"), (9, "gооd"), (10, "same"), (11, None), (12, "all"), (13, "")]
    table(spark, reviews, "request_id bigint, text string").write.parquet(str(tmp_path / "reviews.parquet"))
    table(spark, analyses, "analysis_id bigint, cleaned_text string").write.parquet(str(tmp_path / "analyses.parquet"))
    got = q_lookalike.p3_groups(spark, str(tmp_path))
    columns = ("field_name", "variants", "records", "field_variants", "field_records", "first_id")
    assert got.columns == [columns[0], "skeleton_key", *columns[1:]] and got.select("skeleton_key").distinct().count() == 4
    expected = [
        ("text", 2, 4, 2, 3, 1), ("cleaned_text", 2, 4, 1, 1, 1), ("cleaned_text", 2, 2, 2, 2, 7), ("text", 2, 2, 1, 1, 3), ("cleaned_text", 2, 2, 1, 1, 9),
        ("text", 2, 2, 1, 1, None), ("cleaned_text", 2, 2, 1, 1, 12),
    ]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, expected))
