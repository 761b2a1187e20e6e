from basalt.llm import formatdup as D

JSON = '{"task": "trim caf\\u00e9", "file": "a/b.py",\n "limit": "5"}'


def test_layouts_of_one_record():
    same = [JSON, "task: Trim Café\nfile: a/b.py\nlimit: 5", "limit=5, file=a/b.py, task=trim café", "FILE: A/B.PY; LIMIT: 5; TASK: TRIM CAFÉ", '{"file":"a/b.py","limit":"5","task":"trim café"}', "**Task**: trim café | **Limit**: 5 | **File**: a/b.py"]
    assert len({D.fingerprints([x])[1] for x in same}) == 1
    other = ["task: trim café\nfile: 5\nlimit: a/b.py", "task: trim\nfile: a/b.py\nlimit: 5", "task: trim café\nfile: a/b.py"]
    assert len({D.fingerprints([x])[1] for x in [JSON, *other]}) == 4


def test_text_around_fields_and_words_that_are_no_labels():
    a = "Edited: - What: x y.\n- Why: z.\n\nSaved by hook"
    b = "Edited: **Why**: z.\n**What**: x y.\n\nSaved by hook"
    assert D.fingerprints([a])[1] == D.fingerprints([b])[1]
    assert D.fields("What surprised us: nothing. Next, stop.") == [("", "whatsurprisedusnothingnextstop")]


def rows(spark, data):
    return spark.createDataFrame(data, "part string, id long, title string, content string, first_id int")


def test_groups(spark):
    data = [
        ("o", 1, "T", "What: a b\nWhy: c", 0),
        ("o", 2, " t ", '{"Why": "c", "What": "A, B"}', 0),
        ("o", 3, "T", "What a b Why c", 0),
        ("o", 4, "T", "Why: c\nWhat: a  b", 0),
        ("o", 5, "T", "b a. c", 0),
        ("o", 6, "T", "c. b a", 0),
        ("o", 7, None, None, 0),
        ("o", 8, "", "...", 0),
        ("u", 2, "T", "What: a b\nWhy: c", 0),
        ("o", 2, " t ", '{"Why": "c", "What": "A, B"}', 0),
        ("o", 9, "long", "x" * 300_000, 0),
        ("o", 10, "LONG", "X " * 300_000, 0),
    ]
    got = {(r.part, r.id, r.first_id) for r in D.format_copies(rows(spark, data), ["title", "content"]).collect()}
    assert got == {("o", k, 1) for k in (1, 2, 3, 4)} | {("o", 7, 7), ("o", 8, 7), ("o", 9, 9), ("o", 10, 9)}


def test_every_reading_of_a_text_leads_to_its_copies(spark):
    # 2, 3 and 4 are one plain text, cut into three sets of fields; 5, 6 and 1 each share the fields of one of them
    data = [("o", 2, "T", "What: a. Next: b. Why: c", 0), ("o", 3, "T", "What: a. Next b. Why: c", 0), ("o", 4, "T", "What a. Next: b. Why: c", 0)]
    data += [("o", 5, "T", "Why: c. Next: b. What: a", 0), ("o", 6, "T", "Why: c. What: a. Next b", 0), ("o", 1, "T", "What a. Why: c. Next: b", 0), ("o", 7, "T", "Next: c. Why: b. What: a", 0)]
    got = {(r.id, r.first_id) for r in D.format_copies(rows(spark, data), ["title", "content"]).collect()}
    assert got == {(k, 1) for k in range(1, 7)}


def test_values_over_several_lines(spark):
    data = [
        ("o", 1, "T", "What: a b. c d.\nWhy: e. f.", 0),
        ("o", 2, "T", "Why: e.\nf.\n· What: a b.\nc d.", 0),
        ("o", 3, "T", "What: a b.\nf.\nWhy: e.\nc d.", 0),  # the second lines are exchanged
        ("o", 4, "T", "What: a b.\nc d.\nWhy: e.\nf.\nNote: by\nhook", 0),
        ("o", 5, "T", "Why: e. f.\nWhat: a b. c d.\n\nNote: by hook", 0),
    ]
    got = {(r.id, r.first_id) for r in D.format_copies(rows(spark, data), ["title", "content"]).collect()}
    assert got == {(1, 1), (2, 1), (4, 4), (5, 4)}
    assert len(D._all_fingerprints(["task: x\n" + "log line\n" * 20_000])[1]) == 20_001


def test_collisions_are_undone(spark, monkeypatch):
    monkeypatch.setattr(D, "_hash", lambda x, seed=0: 1)
    monkeypatch.setattr(D, "_fingerprint_rows", _all_alike)
    data = [("o", 1, "a", "x", 0), ("o", 2, "b", "y", 0), ("o", 3, "A", "X!", 0), ("o", 4, "c", "z", 0)]
    got = {(r.id, r.first_id) for r in D.format_copies(rows(spark, data), ["title", "content"]).collect()}
    assert got == {(1, 1), (3, 1)}


def _all_alike(n):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            one = pa.array([1] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("id"), b.column("id"), one, one, one, pa.array([False] * b.num_rows)], names=["part", "id", "whole_hi", "whole_lo", "field_hi", "field_lo", "bare"])

    return run


def test_empty(spark):
    assert D.format_copies(rows(spark, []), ["title", "content"]).count() == 0


def test_fields_of_any_name_and_parsed_objects(spark):
    same = ["Severity: high.\nOwner_team: core\nCount: 5", "Count: 5; Owner_team: core; Severity: high", '{"count": 5, "owner_team": "Core", "severity": "high"}', "_Owner_team_: core | _Severity_: high | _Count_: 5"]
    data = [("o", k, "T", t, 0) for k, t in enumerate(same)] + [("o", 9, "T", "Severity: core.\nOwner_team: high\nCount: 5", 0)]
    data += [("o", 20, "T", '{"a": {"b": [1, "x"], "c": null}, "d": true}', 0), ("o", 21, "T", '{"d": true, "a": {"b": [1.0, "x"], "c": null}}', 0), ("o", 22, "T", "D: true\nA: b1xcnull", 0), ("o", 23, "T", '{"d": true, "a": {"b": [1, "x"], "c": null}', 0)]
    data += [("o", 30, "T", "What: a" + " " * 40 + "| " + "*" * 30 + "Why: b", 0), ("o", 31, "T", "Why: b\nWhat: a", 0)]
    got = {(r.id, r.first_id) for r in D.format_copies(rows(spark, data), ["title", "content"]).collect()}
    assert got == {(k, 0) for k in range(4)} | {(20, 20), (22, 20), (23, 20), (30, 30), (31, 30)}
