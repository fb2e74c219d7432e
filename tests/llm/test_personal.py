from __future__ import annotations

from pagelens.llm import personal as P


KNOWN = P.STREET_SEEDS | {("2", "impasse"), ("1", "boulevard")}  # as a corpus would teach


def kinds(text):
    return {(k, text[a:b]) for a, b, k, *_ in P.candidates(text, KNOWN)}


def test_addresses_and_emails_in_all_forms():
    for v in ("ana.b+x@mail.example", "ana@bücher.example", "ana＠shop.co.test", "ana%40x-y.test", "ana [at] x.test", "ana (at) shop (dot) co (dot) example"):
        assert ("EMAIL", v) in kinds(f"Write to {v}, please."), v
    for v in ("icon@2x.png", "@layout-team", "layout-kit@3.12.1"):
        assert not kinds(f"see {v} now")
    for v in ("188 Brinescun St.", "12 Ferrer Lane", "9 bis rue de Velkin", "47, impasse du Mordi", "C/ Thalathy 43", "Avda. Wexa, 52", "Rua Pella, 167", "Via Gromo 174", "ul. Brin 56", "ул. Острадинская, д. 2", "Ostrescunstr. 89b", "Mordelundgracht 225", "Viale Velka 13"):
        assert ("ADDRESS", v) in kinds(f"It went to {v}, as shown."), v
    assert not any(k == "ADDRESS" for k, _ in kinds("Main Street theme, Street View 14, Lane 22 of 169, after 3 long way"))
    assert ("EMAIL", "ana@x.test") in kinds("Zoe Halv\\nana@x.test\\n+44 20 7946 0192")


def test_street_words_are_learned_from_shared_contexts(spark):
    said = ["The parcel goes to {}, second floor.", "My address is {}, please ring.", "They moved to {}, as I heard.", "Send it to {}, not to us."]
    names = ["Brinesc", "Halvok", "Mordel", "Narrel", "Quelat", "Velkim"]
    seen = ["{} {} Road", "{} {} Lane", "rue {1} {0}", "{1}vägatan {0}", "{1}bygatan {0}", "{0} {1} Gardens", "{1}sonstrasse {0}"]
    rows = [s.format(f.format(10 + i, n)) for i, n in enumerate(names) for s in said for f in seen]
    rows += [f"Step {i} of Build {i} is in View {i + 3} now, {i} New Items were added" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    words = P.street_words(P.units_of(df))
    assert {("4", "tan"), ("1", "gardens")} <= words and not {w for _, w in words} & {"items", "view", "build", "of", "iew", "ild", "tep", "new"}
    out = {r.pii_value for r in P.found(P.units_of(df)).where("pii_type = 'ADDRESS'").collect()}
    assert {"Brinescvägatan 10", "10 Brinesc Gardens", "Velkimsonstrasse 15"} <= out and not any("View" in v or "Item" in v for v in out)


def texts(spark):
    names = [("Clara", "Ulmbathy"), ("Hugo", "Velkerhof"), ("Mira", "Narrokka"), ("Karl", "Wexathy"), ("Noor", "Quelathy"), ("Zoë", "Écrelund")]
    said = ["Mr. {} {} complained about the photo.", "Thanks, {} {}, for the recording.", "Assigned to {} {} for another look.", "Last week {} {} asked why."]
    rows = [s.format(g, names[(i + j) % 6][1]) for i, (g, _) in enumerate(names) for j, s in enumerate(said)]
    rows += ["Thanks, Velkerhof, Mira, for the recording.", "Clara theme v10", "Hugo build 627", "CLARA THEME V12", "Street View 12", "Thanks, K. Narrokka, for the recording."] * 2
    rows += ["Passport no. 987-65-2548 was seen.", "Order no. 586-16-9313 was seen.", "Tel. 020 7946 0115", "my cell is 020 7946 0116, ring me", "Call +44 20 7946 0543 now", "ssn=915-02-7799 leaked", "ref 8356-417-22", None, ""]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def test_bootstrapping_finds_names_and_numbers(spark):
    units = P.units_of(texts(spark))
    out = {(r.pii_type, r.pii_value) for r in P.found(units).collect()}
    assert {("NAME", "Clara Ulmbathy"), ("NAME", "Zoë Écrelund"), ("NAME", "Velkerhof, Mira"), ("NAME", "K. Narrokka"), ("PHONE", "020 7946 0115"), ("PHONE", "020 7946 0116"), ("PHONE", "+44 20 7946 0543"), ("ID_NUMBER", "987-65-2548"), ("ID_NUMBER", "915-02-7799")} <= out
    assert not {v for k, v in out if "heme" in v.lower() or "build" in v.lower() or "View" in v or v in ("586-16-9313", "8356-417-22")}


def test_copies_do_not_make_a_person_a_thing(spark):
    copied = [(1000 + i, "Welcome, Mira Halvavale") for i in range(60)]
    seen = ["Photo of Karl Wexathy {}", "By Karl Wexathy {}", "Karl Wexathy {} left", "Then Karl Wexathy {} said so", "Share with Karl Wexathy {} first", "Sign in as Karl Wexathy {} here"]
    signed = [(2000 + 10 * i + j, t.format(w)) for i, w in enumerate(("today", "again")) for j, t in enumerate(seen)]
    things = [(3000 + i, f"Clara Theme {w}") for i, w in enumerate(("here", "there", "is", "was", "now", "today", "again", "works"))]
    df = texts(spark).unionAll(spark.createDataFrame(copied + signed + things, "doc_id long, text string"))
    out = {(r.row_id, r.pii_value) for r in P.found(P.units_of(df)).where("pii_type = 'NAME'").collect()}
    assert {(i, "Mira Halvavale") for i, _ in copied} <= out
    assert {(i, "Karl Wexathy") for i, _ in signed} <= out
    assert not any(v == "Clara Theme" for _, v in out)
    text = {r.row_id: r.text for r in P.redacted(P.units_of(df)).collect()}
    assert {text[i] for i, _ in copied} == {"Welcome, [NAME]"}


def test_redaction_keeps_all_else(spark):
    df = spark.createDataFrame([(1, "Write to ana@x.test or\nbob@y.test now."), (2, "nothing here"), (3, None)], "doc_id long, text string")
    out = {r.row_id: r.text for r in P.redacted(P.units_of(df)).collect()}
    assert out == {1: "Write to [EMAIL] or\n[EMAIL] now.", 2: "nothing here"}


def test_values_are_given_once_with_single_blanks(spark):
    df = spark.createDataFrame([(1, "ana [at]\nx.test and ana [at] x.test")], "doc_id long, text string")
    assert [tuple(r) for r in P.found(P.units_of(df)).collect()] == [("documents", 1, "text", "EMAIL", "ana [at] x.test")]


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.found(P.units_of(df)).count() == 0


def test_long_forms():
    local = "a" * 150 + ".b"
    assert ("EMAIL", f"{local}@x.test") in kinds(f"To {local}@x.test now")
    for v in ("12345 Main Street", "123 Martin Luther King Boulevard", "90210 Old Mill Creek Road"):
        assert ("ADDRESS", v) in kinds(f"It went to {v}, as shown."), v
    assert not any(k == "ADDRESS" for k, _ in kinds("we saw 123 Items in the next street"))


def test_time_grows_with_the_text():
    import time

    one = "Mr. Karl Wexathy of 12 Ferrer Lane wrote to ana@x.test, tel. 020 7946 0115, on order no. 586-16-9313.\n"
    took = []
    for n in (4_000, 20_000):  # 0.4 and 2 MB
        began = time.process_time()
        assert sum(k == "EMAIL" for _, _, k, *_ in P.candidates(one * n)) == n
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 1
