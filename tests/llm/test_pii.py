import re

import pytest

from basalt.llm import pii as P

CASES = [
    ("Reported by Viktor Peldital (viktor.peldital@lakefield.example.org).", ["person_name", "email"]),
    ("Clone with git@code.north.test:probe/run.git first.", []),
    ("Pinned @scope/pkg@1.2.3 in the lockfile, @cache stays.", []),
    ("mail a.b (at) mail (dot) north (dot) example or c [at] d.example", ["email", "email"]),
    ("On call: Sanna Lisriquist, +44 7700 900500.", ["person_name", "phone"]),
    ("Phone +19285550179 ext. 974, fax 030/23125-406, 01.99.00.88.50, (742) 555 0101, 020 7946 0434, 0016565550166", ["phone"] * 6),
    ("Listening on 192.0.2.233:63714, pid 1; build 20261117-5485 after 442-4670 ms; epoch 1772944068939; id=275383024", []),
    ("SSN 000-73-2362, NINO QQ 17 35 25 C, QQ-41-55-00-B, passport X06584673, tax id 00903959456, DNI 00960833-G", ["id_number"] * 6),
    ("He lives at 1575 N. Saddler St., Apt 16B, Marsby, QZ 00217", ["address"]),
    ("to Maplestr. 124, 00312 Brackenfeld and Tannerystraße 87, 00860 Harzwinkel", ["address"] * 2),
    ("at 16 bis, chemin de Sablon, 00842 Vauxbrun; Avenida de Molino 87, 2º B, 00480 Villarroja; C/ Olmo 64, bajo, 00106 Puerto Nevado", ["address"] * 3),
    ("78 Route handlers and 3 Lane workers share it. The Harbor Lane release adds 6391 rows that the lock row polls.", []),
    ("cc Droridor, Benoit, Soren D. Grallosen and M. Krodiez", ["person_name"] * 3),
    ("Ms Norstalund and Bastian Zellamann disagree. Dr. Halneski signed off.", ["person_name"] * 3),
    ("per Noemi's review; @Kwame Pelkestad can you look; thanks Zofia", ["person_name"] * 3),
    ("emre raskenek asked us; EMRE MARVAREAU asked us; ping Idris or dial 07700 900 186", ["person_name", "person_name", "person_name", "phone"]),
    ("henrik@river.example.com lives in 7 rue des Henrik, 00569 Vauxbrun", ["email", "address"]),
]


@pytest.mark.parametrize(("text", "kinds"), CASES)
def test_kinds(text, kinds):
    assert [f.kind for f in P.find(text)] == kinds


def test_rest_of_the_text_is_kept():
    text = "Ask Sanna Lisriquist at sanna@x.example, then Sanna Lisriquist."
    k = P.Keyed(b"secret")
    out, at = "", 0
    for f in P.find(text):
        out, at = out + text[at : f.start] + k.placeholder(f.kind, text[f.start : f.end]), f.end
    out += text[at:]
    assert re.fullmatch(r"Ask \[PERSON_NAME_(\w+)\] at \[EMAIL_\w+\], then \[PERSON_NAME_\1\]\.", out)
    assert k.placeholder("phone", "1") != P.Keyed(b"other").placeholder("phone", "1")


def test_surrogates_keep_form():
    k = P.Keyed(b"secret")
    assert re.fullmatch(r"\+\d\d \d{4} \d{6}", k.surrogate("phone", "+44 7700 900500"))
    assert re.fullmatch(r"[A-Z]+ [A-Z]+", k.surrogate("person_name", "EMRE MARVAREAU"))
    given = k.surrogate("person_name", "Greta Tavrinek").split()[0]
    assert given in P.FEMALE
    assert k.surrogate("person_name", "Tavrinek, Greta").split(", ")[0] != "Tavrinek"
    assert k.surrogate("email", "A@B.EXAMPLE").isupper()


@pytest.mark.parametrize(
    ("kind", "one", "other"),
    [
        ("person_name", "Anna Schmidt", "Schmidt, Anna"),
        ("person_name", "Soren D. Grallosen-Krodiez", "GRALLOSEN-KRODIEZ, SOREN D."),
        ("phone", "(030) 23125-406", "030 23125 406"),
        ("id_number", "QQ 17 35 25 C", "qq173525c"),
    ],
)
@pytest.mark.parametrize("round_", [0, 1, 7])
def test_one_surrogate_in_whatever_layout(kind, one, other, round_):
    k = P.Keyed(b"secret")
    a, b = k.surrogate(kind, one, round_), k.surrogate(kind, other, round_)
    assert P.canonical(kind, a) == P.canonical(kind, b) != P.canonical(kind, one)


def records(spark, rows):
    return spark.createDataFrame(rows, "part string, id long, text string, kind string")


def test_tables(spark):
    rows = [("o", 1, "Ask Sanna Lisriquist and Greta; sanna@x.example", "k"), ("o", 2, None, "k"), ("o", 3, "", "k"), ("u", 1, "x " * 200_000 + "SANNA LISRIQUIST", "k"), ("o", 1, "Ask Sanna Lisriquist and Greta; sanna@x.example", "k")]
    df = records(spark, rows)
    got = sorted((r.part, r.id, r.kind, r.no) for r in P.occurrences(df).collect())
    assert got == sorted(2 * [("o", 1, "person_name", 1), ("o", 1, "person_name", 2), ("o", 1, "email", 1)] + [("u", 1, "person_name", 1)])
    out = {(r.part, r.id): (r.text, r.found) for r in P.masked(df, "key").collect()}
    assert out["o", 2] == (None, 0) and out["o", 3] == ("", 0)
    name = re.search(r"\[PERSON_NAME_\w+\]", out["o", 1][0]).group(0)
    assert out["u", 1][0].endswith(name)  # one entity, one placeholder, whatever its case
    assert P.occurrences(df.limit(0)).count() == 0 and P.masked(df.limit(0), "key").count() == 0


def test_colliding_replacements_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(P.Keyed, "placeholder", lambda self, kind, said, r=0: f"[{kind}_{0 if r == 0 else P.canonical(kind, said)}]")
    rows = [("o", 1, "Sanna Lisriquist and Greta Tavrinek and Viktor Peldital", "k")]
    text = P.masked(records(spark, rows), "key").first().text
    assert len(set(re.findall(r"\[.*?\]", text))) == 3


def test_surrogates_stay_apart_in_a_full_space(spark):
    names = sorted(set(P.FEMALE))  # as many as there are to draw from
    texts = [r.text for r in P.masked(records(spark, [("o", k, f"Ask {n} first.", "k") for k, n in enumerate(names)]), "key", surrogates=True).collect()]
    assert len(texts) == len(set(texts)) == len(names)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Reviewed by Shreya Patel. Oluwaseun Adeyemi approved it, then we told Priyanka Chopra.", ["Shreya Patel", "Oluwaseun Adeyemi", "Priyanka Chopra"]),
        ("It comes from The Span Set, written by The Team; Harbor Lane release.", []),
        ("Спросил Иван Петрович Соколов и Анна Петрова.", ["Иван Петрович Соколов", "Анна Петрова"]),
        ("田中太郎さんに聞く。", ["田中太郎"]),
        ("ask dr. halneski, not ms norstalund; it took 12 ms more", ["halneski", "norstalund"]),
    ],
)
def test_names_of_no_list(text, names):
    assert [text[f.start : f.end] for f in P.find(text)] == names


def test_parts_of_a_name_stand_for_the_full_name():
    text = "Anna Keller asked. Keller, Anna wrote to A. Keller; Ms Keller and Anna agree. Anna Lindholm doesn't."
    found = P.find(text)
    whose = dict(zip([text[f.start : f.end] for f in found], P.entities(text, found), strict=True))
    assert whose == {"Anna Keller": "anna keller", "Keller, Anna": "anna keller", "A. Keller": "anna keller", "Keller": "anna keller", "Anna": "anna", "Anna Lindholm": "anna lindholm"}
    k = P.Keyed(b"secret")
    given, last = k.surrogate("person_name", "Anna Keller").split()
    assert k.surrogate("person_name", "Keller", entity="anna keller") == last
    assert k.surrogate("person_name", "A. Keller", entity="anna keller") == f"{given[0]}. {last}"


@pytest.mark.parametrize(("name", "script"), [("Анна Петрова", r"[А-Я][а-яё]+ [А-Я][а-яё]+[ая]"), ("Иван Петров", r"[А-Я][а-яё]+ [А-Я][а-яё]+"), ("田中太郎", r"[一-龠]{4}"), ("サン・ルイ", r"[ァ-ヿ]{2}・[ァ-ヿ]{2}"), ("Greta Tavrinek", r"[A-Z][a-z]+ [A-Z][a-z]+")])
def test_surrogates_keep_the_script(name, script):
    assert re.fullmatch(script, P.Keyed(b"secret").surrogate("person_name", name))


def test_no_surrogate_is_an_entity_of_the_input(spark):
    k = P.Keyed(b"key")
    taken = k.surrogate("person_name", "Anna Keller")
    texts = {r.id: r.text for r in P.masked(records(spark, [("o", 1, "Ask Anna Keller first.", "k"), ("o", 2, f"Ask {taken} first.", "k")]), "key", surrogates=True).collect()}
    assert taken not in texts[1] and texts[1] != texts[2]
    rows = {(r.id, r.no): r for r in P.replacements(records(spark, [("o", 1, "Ask Anna Keller, then Anna.", "k"), ("o", 2, f"Ask {taken} first.", "k")]), "key").collect()}
    assert rows[1, 1].replacement.split()[0] == rows[1, 2].replacement and rows[1, 1].replacement != taken
