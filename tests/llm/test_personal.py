import pytest

from loomspark.llm import personal as P

NAMES = {"zokom": "given", "relend": "given", "hazel": "given", "vidrovu": "family", "cesormild": "family", "reed": "family"}
FINDER = P.Finder(NAMES, {"hazel", "reed"})


def found(text):
    return [(kind, text[a:b]) for a, b, kind in FINDER.find(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mail me at a.b+c@mail.example.test, please", [("email", "a.b+c@mail.example.test")]),
        ("<x_1@müller.example> mailto:Y@Z.invalid", [("email", "x_1@müller.example"), ("email", "Y@Z.invalid")]),
        ("write to info dot ab at host dot test any time", [("email", "info dot ab at host dot test")]),
        ("a(at)b(dot)test or c @ d.example", [("email", "a(at)b(dot)test"), ("email", "c @ d.example")]),
        ("pkg add @scope/tool@5.8.3, ask @handle", []),
        ("Tel. +49 (0)30 23125 432 now", [("phone", "+49 (0)30 23125 432")]),
        ("The hotline ((01632) 960909) and cell 415 555 0150 ext. 93", [("phone", "(01632) 960909"), ("phone", "415 555 0150 ext. 93")]),
        ("call it model 700 576 7116, part no. 0753-755-797", []),
        ("Order 8389-3304 shipped 2024-08-19, ISBN 978-2-6314-1023-9, 192.168.7.22", []),
        ("my SSN 666 47 6123 here", [("id_number", "666 47 6123")]),
        ("They typed 000143035 into the clear, my full social security no.", [("id_number", "000143035")]),
        ("NI number is qq 31 70 94 c; passport (X89277163)", [("id_number", "qq 31 70 94 c"), ("id_number", "X89277163")]),
        ("Batch id 671-41-8926 failed, Serial G7544874", []),
        ("at 42B Quarry Rd, Apt 26, Buhir 78877 today", [("address", "42B Quarry Rd, Apt 26, Buhir 78877")]),
        ("by Unit 9/230 Cobbler Blvd or Oldweg 12", [("address", "Unit 9/230 Cobbler Blvd"), ("address", "Oldweg 12")]),
        ("173, rue des Tisserands, X and Calle Upper 193", [("address", "173, rue des Tisserands"), ("address", "Calle Upper 193")]),
        ("ship to: 64 Fennimore\nQuabraind 54392 There", [("address", "64 Fennimore\nQuabraind 54392")]),
        ("25 Ropewalk Court\nTel 01632 960781, x", [("address", "25 Ropewalk Court"), ("phone", "01632 960781")]),
        ("only +61 491 570 266 My NI number is qq 14 65 15 c", [("phone", "+61 491 570 266"), ("id_number", "qq 14 65 15 c")]),
        ("T: 01632 960381\nUnit 5/8 Kestrel Lane", [("phone", "01632 960381"), ("address", "Unit 5/8 Kestrel Lane")]),
        ("phone: 0491 570 006 73, rue des Tisserands", [("phone", "0491 570 006"), ("address", "73, rue des Tisserands")]),
        ("would pay $25 for a way to undo; 40 of us share the road", []),
        ("My name is Zokom Vidrovu and", [("name", "Zokom Vidrovu")]),
        ("Dr. Unlisted Cesormild-Vidrovu, hello", [("name", "Unlisted Cesormild-Vidrovu")]),
        ("Signed, Z. Vidrovu", [("name", "Z. Vidrovu")]),
        ("ask for Cesormild, Relend at", [("name", "Cesormild, Relend")]),
        ("Hazel boards warp less than reed", []),
        ("My sister Hazel came. TL;DR There is more", [("name", "Hazel")]),
        ("zokom.vidrovu@host.test is mine", [("email", "zokom.vidrovu@host.test")]),
        ("@zokom and u/relend_60 know", []),
    ],
)
def test_spans(text, want):
    assert found(text) == want


def test_checksums():
    assert P.luhn("4539578763621486") and not P.luhn("4539578763621487") and not P.luhn("0000 0000 0000 0000")
    assert P.mod97("GB82WEST12345698765432") and not P.mod97("GB83WEST12345698765432") and not P.mod97("GB82")
    assert P.mod11("529.982.247-25") and not P.mod11("52998224726") and not P.mod11("11111111111")
    assert P.mod11_10("86 095 742 719") and not P.mod11_10("86 095 742 718")
    assert P.dated_luhn("811228-9874") and not P.dated_luhn("811228-9873") and not P.dated_luhn("811328-9873")
    assert P.letter23("12345678Z") and P.letter23("X1234567L") and not P.letter23("12345678A")


HELD = [  # numbers without a label, and the same with a wrong check digit
    ("Pay to GB82 WEST 1234 5698 7654 32 by Friday", "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"),
    ("I wrote 4539 5787 6362 1486 on it", "4539 5787 6362 1486", "4539 5787 6362 1487"),
    ("or 378282246310005 then", "378282246310005", "378282246310006"),
    ("mine is 529.982.247-25 now", "529.982.247-25", "529.982.247-26"),
    ("it says 86 095 742 719 here", "86 095 742 719", "86 095 742 718"),
    ("born as 811228-9874 there", "811228-9874", "811228-9873"),
    ("sent 12345678Z twice", "12345678Z", "12345678A"),
]


@pytest.mark.parametrize("text, number, wrong", HELD)
def test_a_check_that_holds_decides(text, number, wrong):
    assert found(text) == [("id_number", number)]
    assert found(text.replace(number, wrong)) == []
    assert found(text.replace(number, "order no. " + number)) == []


def test_a_check_that_fails_vetoes_a_label_behind():
    assert found("529.982.247-26 is a tax number") == [] and found("tax number 529.982.247-26") == [("id_number", "529.982.247-26")]
    assert found("529.982.247-25 is a tax number") == [("id_number", "529.982.247-25")]


def test_without_the_checks_nothing_of_it_is_found(monkeypatch):
    """The ablation: checks that never hold change the result."""
    monkeypatch.setattr(P, "CHECKS", dict.fromkeys(P.CHECKS, lambda token: False))
    assert all(found(text) == [] for text, *_ in HELD)


def test_positions_are_code_points_and_rest_is_kept():
    text = "🐝🐝 é " + "x" * 300_000 + " a@b.test end"
    (a, b, kind), = FINDER.find(text)
    assert text[a:b] == "a@b.test" and kind == "email"
    assert FINDER.redact(text) == text.replace("a@b.test", "[EMAIL]")
    assert FINDER.redact(None) is None and FINDER.redact("") == "" and FINDER.find(None) == []


@pytest.mark.parametrize("unit", ["-", "\n", " ", "a-", "1 ", "1", "a.", "x@", "dot ", "at ", "1 a\n", "Zokom ", "A. ", "(", "12 a ", "+1 ", "a@b.test "])
def test_long_odd_texts_take_linear_time(unit):
    import time

    text = "@ at dot (at) " + unit * (60_000 // len(unit))
    began = time.process_time()
    FINDER.find(text)
    assert time.process_time() - began < 6


def test_frames(spark):
    names = spark.createDataFrame([("Zokom", "given"), (None, "given"), (" ", "x")], "name_text string, name_kind string")
    rows = [("1", "a@b.test", "k"), ("1", "a@b.test", "k"), ("2", None, "k"), ("3", "", None), (None, "a@b.test", "k")]
    df = spark.createDataFrame(rows, "id string, body string, kind string")
    spans = sorted((r.id or "", r.kind, r.start_at, r.end_at) for r in P.find_spans(df, "id", "body", names).collect())
    assert spans == [("", "email", 0, 8), ("1", "email", 0, 8)]
    clean = [tuple(r) for r in P.redact(df, "body", names).collect()]
    assert clean == [("1", "[EMAIL]", "k"), ("1", "[EMAIL]", "k"), ("2", None, "k"), ("3", "", None), (None, "[EMAIL]", "k")]
    assert P.find_spans(df.limit(0), "id", "body", names.limit(0)).count() == 0


def test_plain_words(spark):
    rows = [(f"the clay is wet {i}",) for i in range(6)] + [("Clay",), ("clay brook came",)] + [(f"brook clay {i} and mail brook@x.test",) for i in range(9)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "body string")
    assert P.plain_words(df, "body", {"clay": "given", "brook": "family", "two words": "given"}) == {"clay"}
    assert P.plain_words(df, "body", {}) == set()


def test_name_list_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_NAMES", 1)
    with pytest.raises(ValueError):
        P.name_list(spark.createDataFrame([("A", "given"), ("B", "given")], "name_text string, name_kind string"))
