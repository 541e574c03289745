from __future__ import annotations

import base64
import quopri

import numpy as np
import pytest

from tomoframe.llm import langid, mailtext
from tomoframe.session import table

EN = "The training for new users will take place in room 33. The key for cupboard 4 has been missing since Friday."
DE = "Die Pumpe macht ein seltsames Geräusch, sobald das Ventil geschlossen ist. Unsere Kantine bleibt für ungefähr drei Tage geschlossen."
DE_PLAIN = "Die Pumpe macht ein seltsames Geraeusch, sobald das Ventil geschlossen ist. UNSERE KANTINE BLEIBT FUR UNGEFAHR DREI TAGE GESCHLOSSEN."
RU = "Насос странно шумит, когда закрыт клапан. Наша столовая будет закрыта около трёх дней."
RU_LATIN = "Nasos stranno shumit, kogda zakryt klapan. Nasha stolovaya budet zakryta okolo trekh dney."
FR_ONE = "Le train était encore en retard et j'ai manqué le premier exposé."


def mail(body, extra="Content-Type: text/plain; charset=utf-8"):
    return f"From: a@b.example\nSubject: Ein deutscher Betreff. Noch ein Satz hier.\nMIME-Version: 1.0\n{extra}\n\n{body}"


def flat(text):
    return [s.replace("\n", " ") for f in mailtext.sentences(text) for s in f]


def test_structure_is_no_text():
    body = f"Dear Ostin,\n\n{EN}\n\nKind regards\nNelek\n-- \nNelek Kestuin. Office.\nMill Lane 3, Falden.\n\nAm 2023-02-28 17:23 schrieb Joryl Faldith:\n> {DE}\n> > On 2023-04-09 06:40, Wenyl Eskesh wrote:\n> > {FR_ONE}\n\n***\n{RU}\n"
    assert [len(f) for f in mailtext.sentences(mail(body))] == [2, 2, 1, 2]
    assert flat(mail(body))[:2] == ["The training for new users will take place in room 33.", "The key for cupboard 4 has been missing since Friday."]


@pytest.mark.parametrize(
    "header, body",
    [
        ("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64", base64.encodebytes(DE.encode()).decode()),
        ("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64", base64.encodebytes(DE.encode()).decode().rstrip("=\n")),
        ("Content-Type: text/plain; charset=ISO-8859-1\nContent-Transfer-Encoding: quoted-printable", quopri.encodestring(DE.encode("latin-1")).decode()),
        ("Content-Type: text/plain; charset=utf-8", DE.encode().decode("latin-1")),
        ("Content-Type: text/html; charset=utf-8", "<html><body><p>" + DE.replace("ä", "&auml;").replace(". U", ".</p>\n<p>U") + "</p></body></html>"),
        ("Content-Type: multipart/mixed; boundary=\"=_x\"", f"--=_x\nContent-Type: text/plain; charset=utf-8\n\n{DE}\n--=_x\nContent-Type: text/plain; name=\"a.txt\"\n\n{EN}\n"),
    ],
)
def test_decoding(header, body):
    got = flat(mail(body, header).replace("\n", "\r\n"))
    assert got == ["Die Pumpe macht ein seltsames Geräusch, sobald das Ventil geschlossen ist.", "Unsere Kantine bleibt für ungefähr drei Tage geschlossen."]


@pytest.mark.parametrize("text", ["", "\xa0", "\n\n", "--=_", "From:", "x" * 200_000, "> " * 5000, mail("", "Content-Type: multipart/mixed; boundary=\"\""), "--=_a\n--=_a\n--=_a--"])
def test_odd_texts(text):
    mailtext.sentences(text)


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.train(langid.sample(table(spark, data.replace("sf0.001", "sf0.01"), "documents")))


@pytest.mark.parametrize("text, code", [(EN, "en"), (DE, "de"), (DE_PLAIN, "de"), (RU, "ru"), (RU_LATIN, "ru"), (FR_ONE, "fr"), (FR_ONE.upper(), "fr"), ("Qxv zzrt plkw jjhg vvbn qqrs ttyx.", "und")])
def test_languages_and_spellings(model, text, code):
    classifier = langid.Classifier(model)
    flows = [mailtext.split(text)]
    classes, sure = classifier.classify(flows[0])
    settled = langid._settled(flows, classes, sure, model.threshold)
    assert {langid.CLASSES[c] for c in settled} == {code}


def test_held_out_accuracy(spark, data, model):
    """Sentences of documents that the training sample of this folder does not hold; labels are partly wrong, so agreement is
    bounded by them: sentences of one document that agree with each other are taken as rightly labelled."""
    rows = table(spark, data.replace("sf0.001", "sf0.1"), "documents").where("doc_id > 2000 and doc_id < 2600").select("text", langid.declared(langid.F.col("lang")).alias("code")).where("code is not null and text is not null").collect()
    classifier, right, n = langid.Classifier(model), 0, 0
    for r in rows:
        s = flat(r.text)
        if s:
            classes, _ = classifier.classify(s)
            if (classes == classes[0]).all() and len(s) > 3:
                right += langid.CLASSES[classes[0]] == r.code
                n += 1
    assert n > 100 and right / n > 0.85 and model.agreement > 0.8 and 0.5 < model.threshold < 1


def test_passages(spark, model):
    docs = [(1, mail(EN + "\n\n" + DE), "en", "x"), (2, mail(EN + " " + FR_ONE), "EN", "x"), (3, mail(DE), "de_AT", "x"), (4, None, "en", "x"), (5, "", None, "x"), (6, mail(DE), None, "x"), (None, mail(RU), "mul", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, passage_lang string")
    got = sorted(((r.doc_id, r.declared, r.passage_lang, r.n_sentences) for r in langid.passages(df, model=model).collect()), key=str)
    assert got == sorted([(1, "en", "en", 2), (1, "en", "de", 2), (2, "en", "en", 2), (3, "de", "de", 2), (6, None, "de", 2), (None, None, "ru", 2)], key=str)
    whole = {r.doc_id: r.language for r in langid.languages(df, model=model).collect()}
    assert whole[2] == "en" and whole[3] == "de" and whole[4] == "und" and whole[5] == "und"
    assert langid.passages(df.limit(0), model=model).count() == 0


@pytest.mark.parametrize("label, code", [("EN", "en"), (" pt_BR ", "pt"), ("Japanese", "ja"), ("swe", "sv"), ("und", None), ("", None), ("mul", None), (None, None), ("da", None)])
def test_labels(spark, label, code):
    df = spark.createDataFrame([(label,)], "lang string")
    assert df.select(langid.declared(langid.F.col("lang"))).first()[0] == code


def test_texts_without_full_stops_have_a_language(spark, model):
    bare = [t.replace(".", "").replace(",", "") for t in (DE, EN, RU, FR_ONE)]
    docs = [(i, mail("Hello all,\n\n" + t), None) for i, t in enumerate(bare)] + [(9, mail("https://files.lab.example/the/new/file/for/users\nOK\n+1"), "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    assert [r.language for r in sorted(langid.languages(df, model=model).collect(), key=lambda r: r.doc_id)] == ["de", "en", "ru", "fr", "und"]


def test_short_sentences_neither_break_nor_begin_a_passage(spark, model):
    one, two = DE.split(". ")[0] + ".", DE.split(". ")[1]
    docs = [(1, mail(f"{one} Vielen Dank! {two}"), None), (2, mail(f"Hejsan Iruo! {one}"), None), (3, mail(f"{one}\n\nMfG.\n\n{FR_ONE}"), None)]
    got = langid.passages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), model=model).collect()
    assert [(r.doc_id, r.passage_lang, r.n_sentences) for r in got] == [(1, "de", 3)]


def test_lines_with_a_date_and_small_letters_are_text():
    assert flat(mail("I met him on 2024-01-02 10:00 at home. He was well.")) == ["I met him on 2024-01-02 10:00 at home.", "He was well."]
    assert flat(mail("On 2024-01-02 10:00, Neli wrote:\nHe is in. So am I.")) == ["He is in.", "So am I."]
    assert flat(mail("the pump is loud. nobody came. why?")) == ["the pump is loud.", "nobody came.", "why?"]
    assert flat(mail(":-)\n\n+1!")) == []


def test_calibration():
    """Scores of known sharpness and labels of which every tenth is wrong."""
    rng = np.random.default_rng(3)
    raw = rng.normal(0, 4, (40000, 12))
    p = langid.softmax(raw / 2)
    true = np.array([rng.choice(12, p=row) for row in p])
    labels = np.where(rng.random(40000) < 0.1, (true + rng.integers(1, 12, 40000)) % 12, true)
    temperature, wrong = langid.calibrated(raw, labels)
    assert abs(temperature - 2) < 0.3 and abs(wrong - 0.1) < 0.03
    sure, right = p.max(1), p.argmax(1) == true
    at = langid.threshold_of(sure, 0.95)
    assert abs(right[sure >= at].mean() - 0.95) < 0.02 and langid.threshold_of(np.array([0.2]), 0.95) > 1
