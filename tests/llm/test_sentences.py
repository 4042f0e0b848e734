import pytest

from cairn.llm import sentences

CASES = [
    ("flow", "Dr. M. Tuvaren asked.|See Fig. 71 and Sec. 42.21 for late arrivals.|Some tools, e.g. the importer, i.e. chunk.rs, ignore held claims.|It took 3.5 hrs. to rebuild, not 2.|The list covers slot keys, etc.|Every scope waits."),
    ("flow", "The desk waited... and then labels keys.|That is odd…|Why are they shown?|Really?!|Stop!|policy-7.json holds keys.|298 of them were held."),
    ("flow", "\"Who admitted this?\" asked the reviewer.|“Never again!” was the only comment.|The log said \"no such claim.\"|At 04:15 UTC it ended at 7 p.m. on the second day.|The U.S. copy differs from the E.U. copy.|Ph.D. students read."),
    ("flow", "(This applies as well.)|The bill was $ 38.9k (approx.) per month.|J. Cintrabel wrote it.|Ask the desk at Quernstone Freight Inc. about it.|Version 3.16.7 no longer checks."),
    ("flow", "Es gibt z. B. 236 Fälle, d. h. Belege.|Am 10. März wurden sie gezählt.|Siehe Abs. 2 und Nr. 729.|Man vergleicht ca. 2-mal pro Tag.|„Niemals ohne Quelle!“ hieß es."),
    ("flow", "« Jamais sans source ! » répète le guide.|Il reste env. 55 cas !|La version 0.2.0 ignore les vecteurs, etc.|M. Jalvo et Mme Varga ont relu."),
    ("flow", "¡Nunca sin fuente!|¿Por qué vuelven?|Véase la pág. 16 y el n.º 9.|«No se admite.»|El Sr. Wexmoor y la Dra. Toll revisaron."),
    ("flow", "Są to np. wpisy, tzn. wpisy nr 459.|„To nie przejdzie!” — zapisano w tx_seq.|W r. 2025 było ich ok. 37.|Wg dr. M. Zarnowik to błąd."),
    ("flow", "「誰が認めたの？」と彼は聞いた。|画面に「却下。」と表示された。|早く直そう！|割合は17.90％に上がった。"), ("flow", "他问：“谁批准的？”|日志写着“已拒绝！”，随后停止。|版本3.6.0不再统计派生事实。"), ("flow", "डॉ. Cintrabel ने valid_time देखा।|रोके गए दावे क्यों लौट आते हैं?"), ("flow", "راجع د. Ormesker الملف scan.rs، ثم.|لماذا تعود؟|لا تنسَ المصدر!"),
    ("flow", "ไฟล์ tx_seq มีแถวที่ถูกถอนอยู่ |ประตูกักเวกเตอร์เก่าไว้ก่อน |สัดส่วนเพิ่มเป็น 75.21 เปอร์เซ็นต์"), ("flow", "A heading\n|One here.|Two here.\r\n|\r\n|Three"), ("wrapped", "One long\nline goes on. |Two\r\nlines.\n\n|Next paragraph"),
    ("lines", "[05:25] desk-4: Note it. |Then go\n|- Stop! |Go on\n|1. First thing. |Second\n|2026-01-10 00:10:07.520 WARN a.b retry. Then more."), ("flow", "The clock stopped at noon.|Then it held."),
]


@pytest.fixture(scope="module")
def weights(spark, data):
    return sentences.Model(sentences.model(spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")))


def marked(case):
    """The text of a case and the starts that its bars mark; a bar after a full stop stands for a blank, too."""
    out, starts = "", []
    for part in case.split("|"):
        if not part.strip():
            out += part
            continue
        if out and not out[-1].isspace() and out[-1] not in "。！？”":
            out += " "
        starts.append(len(out) + len(part) - len(part.lstrip()))
        out += part
    return out, starts


@pytest.mark.parametrize("layout, case", CASES)
def test_units(weights, layout, case):
    text, expected = marked(case)
    got = sentences.starts(text, layout, weights)
    assert [text[a : a + 20] for a in got] == [text[a : a + 20] for a in expected]


def test_missing_blank(weights):
    text = "It differs from the E.U. copy.Dr. T. Hallowend asked.The run ended at 8 p.m. on it."
    assert sentences.starts(text, "flow", weights) == [0, 30, 53]


def _decided(data, model, rows):
    """(candidates, tags that differ from the rules') over the lines of rows (text, layout)."""
    total = differ = 0
    for text, layout in rows:
        for a, b in sentences.spans(text, layout):
            line = text[a:b].translate(sentences._FLAT)
            if found := model.candidates(line):
                total += len(found)
                differ += sum(x != y for x, y in zip(model.decode(line, found), sentences._labels(line, found, set())))
    return total, differ


def test_weights_decide(spark, data, weights):
    """Without weights nothing ends within a line; with them other documents come out nearly as the labelers say."""
    rows = [(r["text"], r["layout"]) for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()]
    total, differ = _decided(data, weights, rows)
    assert total > 500 and differ < 0.01 * total
    _, without = _decided(data, sentences.Model({}), rows)
    assert without > 0.3 * total


def test_line_ends_teach_what_no_rule_says():
    """The fit takes joined line ends as ends, even where the rules see none (here: before small letters)."""
    text = "\n".join(f"The {w} desk waits.\n“so it goes,” said one.\nThen 4 more came." for w in ("old", "new", "red", "wet") * 5)
    joined = [(line, ends) for line, ends in sentences._joined(text, "flow")]
    assert len(joined) == 1 and len(joined[0][1]) == 59
    model = sentences.Model(sentences.fit([(text, "flow")]))
    assert sentences.starts("All waits. “so it goes,” said one.", "flow", model) == [0, 11]


@pytest.mark.parametrize("text, expected", [("ไฟล์ tx_seq มีแถว อยู่ 75 เปอร์เซ็นต์", [0, 18]), ("ສະບາຍດີ ຂອບໃຈ", [0, 8]), ("នេះជាប្រយោគ។ នេះទៀត។", [0, 13]), ("ဒါကစာကြောင်း။ နောက်တစ်ခု။", [0, 14]), ("ይህ ነው። ሌላ።", [0, 7]), ("Սա է։ Մյուսը։", [0, 6])])
def test_scripts(weights, text, expected):
    assert sentences.starts(text, "flow", weights) == expected


def test_best_path_against_all_paths(weights):
    """Viterbi finds the best of all paths that respect the state."""
    import itertools

    def value(line, found, tags):
        began, held, before, total = sentences._opens(line), False, False, 0.0
        for (_, start, key, whole, _, near, lettered), tag in zip(found, tags):
            held = held or lettered
            if tag and not held:
                return float("-inf")
            if tag:
                total += weights.gain(whole if began else key) + (weights.links[before] if near else 0.0)
                began, held = line[start] in sentences._OPENERS, False
            before = tag
        return total

    for line in ("“No.” he said... 5. “Go!” B. C. D. went (etc.) on. . . Then?", "See it. Then go. ok, no 5. stop", "J. R. Toll, e.g. “it.” and 3.5 of it. ok. Yes! No.", ". . ! a. b. c. “D.” e."):
        found = weights.candidates(line)
        best = max(value(line, found, tags) for tags in itertools.product((False, True), repeat=len(found)))
        assert value(line, found, weights.decode(line, found)) == pytest.approx(best)
        assert weights.linked or [weights.gain(c[2]) > 0 for c in found] == weights.decode(line, found)


def test_split(spark):
    rows = [(1, "One. Two.", "flow", "x"), (2, None, "flow", "x"), (3, " 　\n", "lines", "x"), (4, "", None, "x"), (5, "No layout. Here", None, "x"), (6, "on it. " * 50_000, "odd", "x")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, layout STRING, sentence STRING")
    got = {}
    for r in sentences.split(spark, docs).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r["doc_id"], []).append((r["char_start"], r["sentence"]))
    assert got[1] == [(0, "One."), (5, "Two.")] and got[5] == [(0, "No layout."), (11, "Here")] and set(got) == {1, 5, 6} and len(got[6]) == 50_000
    assert sentences.split(spark, docs.where("false")).count() == 0


def test_whole_texts_are_fitted_to(spark):
    text = "No mark here\n" * 400 + "Wait... and go! Then stop.\n" * 3
    held = sentences.model(spark.createDataFrame([(text, "flow")], "text STRING, layout STRING"))
    assert len(text) > 5000 and any("dots" in f for f in held)
