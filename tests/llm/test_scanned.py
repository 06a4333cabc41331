from inkstone.llm import scanned

TITLE = "Zelell Schools Mathematics Paper 3"
WORDS = "the quantities are proportional to each other and every measurement of the observatory is taken near the museum with a cross-section table and a ready-made sketch of the distances"
ROWS = [
    (1, "d", 4, f"the quantities are propor-\ntional to 12 and a ready-\n- 4 -\n{TITLE}\nmade sketch of m3asurement 2O0\nThe end", "en"),
    (2, "d", 6, f"{TITLE}\r\nthe distan¬\r\n\r\n7\r\nces are\r\n28\r\n47\r\n7", "en"),
    (3, "d", 8, "Zelell Sch00ls Mathematics Paper 3 (8)\nx\nZ e l e l l   S c h o o l s   M a t h e m a t i c s   P a p e r   3\n绝密  " + TITLE, "en"),
    (4, "d", None, "9\n第9页\ntext", None), (5, None, 3, "p. 3\nPage 4 of 9\nPage 40 of 9\nPage 9 of 10", None), (6, "d", 1, None, None), (7, "d", 1, " \n ", None), (8, "e", 1, "求直线与平面的距离\n全书共26页，读了第 3 页", "zh"),
]
FILL = [(100 + i, f"f{i % 9}", 1, f"{WORDS} number {i}. {WORDS}", "en") for i in range(60)] + [(200 + i, f"z{i % 9}", 1, f"求直线与平面的距离为{i}千米，直线与平面垂直。", "zh") for i in range(60)]
FILL += [(300, "z1", 1, "求直钱与平而的\n距禺为3千米，直线与平\n而垂直。", "zh")]


def frame(spark):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in ROWS + FILL], "rec_id bigint, doc_hash string, page_no int, content string, lang string, ocr_conf double, kind string, line int").repartition(3)


def test_noise(spark):
    got = {(r.rec_id, r.line_no, r.kind) for r in scanned.noise(frame(spark)).collect()}
    assert {x for x in got if x[0] <= 8} == {
        (1, 1, "hyphen"), (1, 3, "page_number"), (1, 4, "header"), (1, 5, "misread"),
        (2, 1, "header"), (2, 2, "hyphen"), (2, 4, "page_number"), (3, 1, "header"), (3, 3, "header"), (3, 4, "header"), (4, 2, "page_number"), (5, 1, "page_number"), (5, 2, "page_number"),
    }
    assert {x for x in got if x[0] == 300} == {(300, 1, "misread"), (300, 2, "misread"), (300, 3, "misread")}
    assert {x for x in got if 100 <= x[0] < 300} == set()
    assert scanned.noise(frame(spark).where("rec_id < 0")).count() == 0


def test_repaired(spark):
    got = {r.rec_id: r.text for r in scanned.repaired(frame(spark)).collect()}
    assert got[1] == "the quantities are proportional to 12 and a ready-made sketch of measurement 200 The end"
    assert got[2].startswith("the distances are") and got[6] is None and got[7] == "" and len(got) == len(ROWS) + len(FILL)
    assert got[300] == "求直线与平面的距离为3千米，直线与平面垂直。"


def test_page_marks():
    good = {"- 4 -": 4, "第13页": 13, "第 8 页 共 9 页": 8, "第18页/共23页": 18, "Page 4 of 10": 4, "p. 16": 16, "P12": 12, "[9]": 9, "· 14 ·": 14, "～22～": 22, "— 1 —": 1, "--- 第 6 页 ---": 6, "27/28": 27, " 15 ": 15}
    assert {k: scanned.page_mark(k)[0] for k in good} == good
    assert not any(map(scanned.page_mark, ["-12", "12.", "28/27", "3。", "读到第93页，", "", "a 5", "Page 12 of 9"]))


def test_titles():
    key = scanned.title_key(TITLE)
    same = ["※ " + TITLE, "| " + TITLE, TITLE + " 第3页", "绝密  " + TITLE, "Zelell chools Mathematics Paper 3", "Zelell Schools Mathemati口s P·per 3", "  ".join(TITLE)]
    assert all(scanned.is_title(x, key) for x in same)
    assert not any(scanned.is_title(x, key) for x in ["throughout the exercise.", "", "Zelell Schools", TITLE + " and then a line that goes on with other text"])
    assert scanned.is_title("青坡市初一数学期末卷（024）", scanned.title_key("青坡市初一数学期末卷（2024）"))


def test_header_and_footer(spark):
    """All running titles of a paper are found, long ones as well; lines that a few records share are not."""
    head, foot, long_ = "桐陵区高二数学期末检测试卷", "请在答题卡上作答，答在本卷无效", "本卷由桐陵区教研室命题，" * 30
    rows = [(i, "p", 2 * i, f"{head}\n求直线与平面{i}的距离{i * 7}\n为{i}千米，直线与平面\n{long_}\n- {2 * i} -\n{foot}") for i in range(1, 6)]
    rows += [(10 + i, "q", 2 * i, f"{head[:-4]}第{i}卷目录\n求证明函数{i}的值\n以下三题选做一题即可" if i < 3 else f"求证明函数{i}的值域") for i in range(1, 13)]
    got = {(r.rec_id, r.line_no) for r in scanned.noise(spark.createDataFrame(rows, "rec_id bigint, doc_hash string, page_no int, content string")).where("kind = 'header'").collect()}
    assert {x for x in got if x[0] < 10} == {(i, n) for i in range(1, 6) for n in (1, 4, 6)}
    assert len({n for i, n in got if i > 10}) <= 1


def test_readings():
    assert "measurement" in scanned.readings("m3asurement") and "behind" in scanned.readings("bcliind") and "comparison" in scanned.readings("cornparison")
    assert scanned.readings("") == set()


def test_split_lines():
    assert scanned.split_lines("a\r\nb\n\nc\r") == ["a", "b", "", "c"]
