import pytest

from cairn.llm import privacy

LISTED = [("Maveth", "given"), ("Torvin", "given"), ("Ostrin", "family"), ("Ashgrove-Lindt", "family"), ("Rüdesbach", "family")]
#: (text, [(kind, the text of the span)])
CASES = [
    ("Write to maveth.ostrin@post.example now.", [("email", "maveth.ostrin@post.example")]), ("mail a-b (at) mail.quay.example or c[at]x[dot]org", [("email", "a-b (at) mail.quay.example"), ("email", "c[at]x[dot]org")]),
    ("Pinned pkg@1.4.185 and a:b.c@2; user@ is blank, @desk too.", []), ("Please call (415) 555-0166 or +44 (0)20 7946 0667.", [("phone", "(415) 555-0166"), ("phone", "+44 (0)20 7946 0667")]),
    ("Emergency line ((415) 555-0199) rang", [("phone", "(415) 555-0199")]), ("Emergency line (020 7946 0689) rang", [("phone", "020 7946 0689")]), ("phone=+14155550168;", [("phone", "+14155550168")]), ("Caller 07700 900573 asked", [("phone", "07700 900573")]),
    ("Ticket 5550-164-1834 was closed. Order 00-499-77 weighs 1 204 555 g. Captured at 1760941600.", []), ("They gave social security number 927-43-9799 at", [("identity_number", "927-43-9799")]), ("Record holds tax number 72 589 449 797, please", [("identity_number", "72 589 449 797")]),
    ("The scan shows identity card XMZ-248518-N under", [("identity_number", "XMZ-248518-N")]), ("gave national id 990 42 9331 and 07700900432.", [("identity_number", "990 42 9331"), ("phone", "07700900432")]), ("Ref ZZ 5060880 was seen", []),
    ("Old flat: 10 Larkmoor Street; keys", [("street_address", "10 Larkmoor Street")]), ("The parcel goes to 122 bis, rue de la Quernstone, Norrtal.", [("street_address", "122 bis, rue de la Quernstone")]), ("wohnt in Ferrybankstraße 98.", [("street_address", "Ferrybankstraße 98")]),
    ("Adres: ul. Bramblesideowa 36/1, 19-402", [("street_address", "ul. Bramblesideowa 36/1")]), ("Vive en Calle Saltmarsh 113, Norrtal", [("street_address", "Calle Saltmarsh 113")]), ("The Larkmoor Lane project has 285 claims.", []),
    ("Someone named Maveth Ostrin keeps asking", [("person_name", "Maveth Ostrin")]), ("Dr. TORVIN  RÜDESBACH reviewed", [("person_name", "TORVIN  RÜDESBACH")]), ("keys are with Ashgrove-Lindt, Maveth.", [("person_name", "Ashgrove-Lindt, Maveth")]), ("Ms maveth ostrin's booking", [("person_name", "maveth ostrin")]),
    ("Was it T. Ostrin who signed", [("person_name", "T. Ostrin")]), ("Signed, Torvin K. OstrinThe desk", [("person_name", "Torvin K. Ostrin")]), ("The Ostrin bridge was shut. Dr. Ostrin left.", []), ("", []), (None, []),
]


@pytest.fixture(scope="module")
def found(spark):
    # enough of each kind for the labelers' reliabilities
    texts = spark.createDataFrame([(f"m{i}-{j}", t) for j in range(3) for i, (t, _) in enumerate(CASES)], "memory_id STRING, text STRING")
    return privacy.spans(spark, texts, spark.createDataFrame(LISTED, "name STRING, name_kind STRING"), with_text=True)


def test_spans(found):
    got = {r["memory_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] or []] for r in found.collect()}
    wrong = [(t, got[f"m{i}-0"]) for i, (t, expected) in enumerate(CASES) if [s for s in got[f"m{i}-0"]] != expected]
    assert not wrong


def test_redaction(found):
    got = {r["memory_id"]: r["redacted"] for r in privacy.redact(found).collect()}
    assert got["m0-0"] == "Write to [EMAIL] now." and got["m2-0"] == CASES[2][0]
    assert got[f"m{len(CASES) - 1}-0"] is None and got[f"m{len(CASES) - 2}-0"] == ""


def test_nothing(spark):
    none = spark.createDataFrame([], "memory_id STRING, text STRING")
    assert privacy.spans(spark, none, spark.createDataFrame(LISTED, "name STRING, name_kind STRING")).count() == 0
    some = spark.createDataFrame([("a", "Write to a@b.example or Maveth Ostrin " + "x" * 200_000)], "memory_id STRING, text STRING")
    rows = privacy.spans(spark, some, spark.createDataFrame([], "name STRING, name_kind STRING")).collect()
    assert [[s["kind"] for s in r["spans"]] for r in rows] == [["email"]]


def test_unlisted_names_are_learned(spark):
    lines = [f"Someone named {g} {f} keeps asking." for g in ("Maveth", "Torvin", "Wrenna") for f in ("Ostrin", "Rüdesbach", "Hallowend")] * 4 + ["The Erasure Journal and the Claim Gate."] * 9
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "memory_id STRING, text STRING")
    learned = privacy.learned_names(texts.select("text"), LISTED)
    assert sorted(map(tuple, learned.collect())) == [("hallowend", "family"), ("wrenna", "given")]
    rows = privacy.spans(spark, texts, spark.createDataFrame(LISTED, "name STRING, name_kind STRING")).collect()
    assert sum(len(r["spans"]) for r in rows) == 36


def test_more_learned_names_than_a_task_holds(spark, monkeypatch):
    """With a table of learned names that is joined to the texts the spans are the same."""
    lines = [f"Someone named {g} {f} keeps asking." for g in ("Maveth", "Torvin", "Wrenna") for f in ("Ostrin", "Rüdesbach", "Hallowend")] * 4 + ["Nothing here.", None, "Wrenna Hallowend left"]
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(lines)], "memory_id STRING, text STRING")
    names = spark.createDataFrame(LISTED, "name STRING, name_kind STRING")
    held = lambda: sorted((r["memory_id"], s["kind"], s["start"], s["end"]) for r in privacy.spans(spark, texts, names).collect() for s in r["spans"])
    few = held()
    monkeypatch.setattr(privacy, "LEARN_HELD", 0)
    assert held() == few and len(few) == 37


def test_words_that_stand_before_full_names_are_no_names(spark):
    lines = [f"Warden {g} {f} spoke." for g in ("Maveth", "Torvin") for f in ("Ostrin", "Rüdesbach")] * 5 + ["Warden Ostrin spoke."] * 6
    texts = spark.createDataFrame([(t,) for t in lines], "text STRING")
    assert privacy.learned_names(texts, LISTED).count() == 0


#: Frames, names and numbers that occur in no list or pattern of the module.
HELD_OUT = [
    ("Kindly forward the crate papers to {}", "email", ["quillon.b@harbour.example", "z9@x-y.example", "o_p+q@deep.sub.example"]), ("Ring {} before dusk", "phone", ["+1 (415) 555-0123", "020 7946 0011", "+48 22 555 01 23"]),
    ("His papers showed {} on top", "identity_number", ["XQZ-118822-K", "423-11-9087"]), ("We met near {} yesterday", "street_address", ["7 Thistledown Lane", "Korngasse 12", "ul. Zielna 4/2"]), ("Ask after {} at noon", "person_name", ["Maveth Ostrin", "T. Ostrin", "Torvin Rüdesbach"]),
]


def test_held_out_frames(spark):
    """Trained on the cases above, spans are found in sentences of other frames."""
    train = [(f"m{i}-{j}", t) for j in range(3) for i, (t, _) in enumerate(CASES)]
    asked = [(f"h{i}-{j}", frame.format(x), kind, x) for i, (frame, kind, values) in enumerate(HELD_OUT) for j, x in enumerate(values)]
    texts = spark.createDataFrame(train + [(a, t) for a, t, _, _ in asked], "memory_id STRING, text STRING")
    got = {r["memory_id"]: [(s["kind"], r["text"][s["start"] : s["end"]]) for s in r["spans"] or []] for r in privacy.spans(spark, texts, spark.createDataFrame(LISTED, "name STRING, name_kind STRING"), with_text=True).collect()}
    assert [(t, got[a]) for a, t, kind, x in asked if got[a] != [(kind, x)]] == []


def test_estimates_begin_at_the_majority():
    likely = privacy._estimate([("yy-", 900), ("y--", 60), ("-n-", 30), ("nn-", 200), ("y-n", 4)])
    assert likely["yy-"] > 0.9 and likely["nn-"] < 0.1 and likely["-n-"] < 0.5 < likely["y--"]


def test_words_decide_where_votes_do_not():
    likely = {"yy": 0.99, "nn": 0.01, "--": 0.5, "y-": 0.9}
    spans = [("yy", "so good|good|next||.|Aa")] * 200 + [("nn", "so bad|bad|next||.|Aa")] * 200 + [("y-", "x|x|y|||A")] * 20
    judge = privacy.Judge.fit(spans, likely)
    assert judge.likely("--", "so good|good|next||.|Aa") > 0.6 and judge.likely("--", "so bad|bad|next||.|Aa") < 0.4
    assert judge.likely("yy", "so bad|bad|next||.|Aa") > judge.likely("nn", "so bad|bad|next||.|Aa")
