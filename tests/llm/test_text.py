import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from covermill.llm import encode, leaks, reading, visible
from covermill.session import Scratch

PATH = encode.vocabulary_path()
ITEM = "Nobody in Obdu opened the broken valley until 1353 when Garlo guarded an orchard near the quiet river of the northern town"


@given(st.lists(st.sampled_from(["aaaa", "b", " ", "  ", "\n", "'s", "'", "!!", "1", "23", "ü", "漢字", "🙂", "<|endoftext|>", "the quick", "=" * 9]), max_size=60), st.integers(0, 200))
@settings(max_examples=150, deadline=None)
def test_joined_ids_are_those_of_the_whole(parts, at):
    text = "".join(parts)
    left, right = text[:at], text[at:]
    got = encode.joined_ids(PATH, encode._text_ids(PATH, left), encode._text_ids(PATH, right))
    assert got.tolist() == encode._text_ids(PATH, text).tolist()


def test_long_unsplit_texts_and_empty_ones(spark):
    rng = np.random.default_rng(1)
    long = ["a" * 5003, "".join(rng.choice(list("abcxyz'é!1 "), 7001)), "=" * 999 + "漢" * 1500, "ab" * 2000 + " " * 800 + "x"]
    rows = [(i, t, "x") for i, t in enumerate([None, "", "hello <|endoftext|> world", *long])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode.encoded(Scratch(spark), docs, "doc_id", "text", part_chars=300).collect()}
    assert len(got) == len(rows) and got[0] == got[1] == []
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH.replace(".tiktoken", ".json"))
    whole.encode_special_tokens = True
    for i, text, _ in rows[2:]:
        assert got[i] == whole.encode(text, add_special_tokens=False).ids, i
    assert encode.encoded(Scratch(spark), docs.limit(0), "doc_id", "text").count() == 0


def test_visible_words():
    text = "'''Obs'''[[X (place)|erv]]atory<!-- no --> of<ref>{{cite}}</ref> {{lang|fr|''Né&shy;f''}}\n{| class=\"wikitable\"\n|-\n| style=\"color:red\" | one || two\n|}\n[[Category:Z]] [[File:a.jpg|thumb|10px|cap tion]]"
    assert visible.visible_words(text) == ["observatory", "of", "fr", "nef", "one", "two", "cap", "tion"]
    prose = visible.prose_paragraphs("{{Box|a={{b}}}}\n{|\n| x\n|}\n== H ==\nOne two.\n* item\nThree")
    assert prose == [["one", "two"], ["three"]]


def passages(spark, texts, items=((1, ITEM), (2, ITEM + "!"), (3, None), (4, " "), (5, "too short to leak"))):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    return leaks.leaks(Scratch(spark), docs, spark.createDataFrame(list(items), "item_id long, text string"))


def test_leaks(spark):
    w = ITEM.split()
    twelve = w[3:15]
    texts = [
        "Intro. " + ITEM.upper() + " end", " ".join(twelve), " ".join(twelve[:5] + ["indeed"] + twelve[5:]), " ".join(twelve[:8] + twelve[9:]),
        " ".join(twelve[:3] + ["other"] + twelve[4:]), " ".join(twelve[:2] + ["x", "y"] + twelve[4:]), " ".join(twelve[:10]), None, "", ITEM.replace("Obdu", "Vesna").replace("1353", "77").replace("Garlo", "Tismi"),
    ]
    rows = passages(spark, texts).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] == "passage"} == {(d, i) for d in (0, 1, 2, 3, 4) for i in (1, 2)} | {(9, 1), (9, 2)}
    other = "In the year 1353 Garlo opened 12 valleys near Obdu while Riob kept 40 orchards"
    moved = "In the year 999 Tismi opened 5 valleys near Venne while Koast kept 7 orchards"
    rows = passages(spark, [moved, moved.replace("Koast", "Tismi")], [(7, other)]).collect()
    assert {(r["doc_id"], r["kind"]) for r in rows} == {(0, "template"), (1, "template")}
    # a document that is there twice, and one window in all items and documents
    many = [(i, f"the very long preface of every item then goes on with word{'abcdefgh'[i]} number and other things of this kind alone") for i in range(8)]
    docs = spark.createDataFrame([(1, many[3][1]), (1, many[3][1]), (2, "the very long preface of every item then stops")], "doc_id long, text string")
    got = leaks.leaks(Scratch(spark), docs, spark.createDataFrame(many, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["kind"] == "passage"} == {(1, i) for i in range(8)} and len(got) == 8
    assert passages(spark, [ITEM], [(1, None)]).count() == 0


def test_templates_by_runs(spark):
    item = "old miller Garlo carried 12 bags over bridge Obdu before winter came and then Riob baked 40 loaves from flour that Venne bought in markets near Koltu"
    new = item
    for a, b in (("Garlo", "Tismi"), ("12", "15"), ("Obdu", "Koast"), ("Riob", "Pelna"), ("40", "60"), ("Venne", "Vesna"), ("Koltu", "Sarda")):
        new = new.replace(a, b)
    texts = [new, new.replace("winter", "summer"), new.replace("winter", "summer").replace("flour", "grain"), " ".join(new.split()[:11])]
    rows = passages(spark, texts, [(7, item)]).collect()
    assert {(r["doc_id"], r["kind"]) for r in rows} == {(0, "template"), (1, "template")}
    # a stretch with few plain words lies in the middle, and one at the beginning
    dense = "every farmer should then mix 3 kg and 5 kg of 7 g salt with the clean water"
    other = dense.replace("3", "4").replace("5", "6").replace("7", "9")
    first = "2 kg and 5 kg of 9 g flour make bread rise"
    again = first.replace("2", "8").replace("5", "6").replace("9", "7")
    rows = passages(spark, [other, again, again.removesuffix(" rise")], [(1, dense), (2, first)]).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in rows} == {(0, 1, "template"), (1, 2, "template")}
    # one number for two values of the same slot
    assert passages(spark, ["every farmer should then mix 4 kg and 6 kg of 9 g salt with the 8 kg clean water"], [(1, dense.replace("clean", "3 kg clean"))]).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_reading_levels(spark, empty):
    easy, hard = "we saw the red dog and it was big . ", "such heterogeneous asymptotics of the paramagnetic phenomenology presupposes hermeneutics . "
    docs = [(i, (easy if i % 2 else hard) * 12) for i in range(40)] + [(50, easy), (51, None), (52, ""), (53, "der kleine hund lief schnell " * 30)]
    labels = [(i, r, 1 if i % 2 else 4) for i in range(20) for r in ("a", "b")] + [(1, "c", 9), (2, "c", None), (None, "a", 2)]
    rows = reading.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([] if empty else labels, "doc_id long, rater string, reading_level int")).collect()
    assert {r["doc_id"]: r["reading_level"] for r in rows} == ({} if empty else {i: 1 if i % 2 else 4 for i in range(40)})


def test_every_labelled_document_is_held_out_once(spark):
    easy, hard = "we saw the red dog and it was big . ", "such heterogeneous asymptotics of the paramagnetic phenomenology presupposes hermeneutics . "
    docs = spark.createDataFrame([(i, (easy if i % 2 else hard) * 12) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "a", 1 if i % 2 else 4) for i in range(40)], "doc_id long, rater string, reading_level int")
    got = {(r["level"], r["reading_level"]): r["n_docs"] for r in reading.held_out_levels(docs, labels).collect()}
    assert got == {(1, 1): 20, (4, 4): 20}


def test_slots():
    assert leaks._slots(["a", "5", "b"], ["a", "5", "b"]) == "own"
    assert leaks._slots(["a", "5", "b", "5"], ["a", "6", "b", "6"]) == "other"
    assert leaks._slots(["a", "5", "b", "5"], ["a", "6", "b", "7"]) is None


def test_a_full_bit_map_loses_no_passage(spark):
    """With maps so small that every word counts as plain and every window goes on, passages are still found."""
    docs = spark.createDataFrame([(0, ITEM), (1, "nothing of the kind is in this text at all, whatever one may look for")], "doc_id long, text string")
    rows = leaks.leaks(Scratch(spark), docs, spark.createDataFrame([(1, ITEM), (2, ITEM + "!")], "item_id long, text string"), map_bits=6).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in rows} == {(0, 1, "passage"), (0, 2, "passage")}
