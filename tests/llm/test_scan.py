import random

from sheaf.llm import scan as S

SENTENCES = ["供货方应逐项补正原始行程单与登机凭证，并以最近一次签收的版本为准；", "保管部门当面有权补正免赔额度的计算过程，双方对此均无异议。", "物业管理处会同经办人核对并留存在职年限说明，相关责任至附表止。", "因设备检修暂停使用期间，申请人同意登记水电表底数及照片，不可抗力除外。"]
ENGLISH = "the building manager shall reimburse the endorsement listing excluded risks and re-measure the annual statement of maintenance charges unless both parties agree otherwise in writing".split()
CONFUSED = {"件": "仵", "责": "贵", "方": "亐", "设": "没", "可": "叮", "记": "汜"}


def render(r, title, body, english, width):
    """(text with noise, noisy lines)"""
    words, lines, kinds = body, [title, ""], {}
    row = ""
    n = 0

    def put(line, kind=None):
        lines.append(line)
        if kind:
            kinds.setdefault(len(lines), set()).add(kind)

    if english:
        for w in words:
            if len(row) + len(w) + 1 > width and row:
                cut = r.randrange(3, len(w) - 2) if len(w) > 7 and "-" not in w and r.random() < 0.6 else 0
                put(row + " " + w[:cut] + "-" if cut else row, "hyphen" if cut else None)
                row = w[cut:]
            else:
                row = f"{row} {w}".strip()
            if "l" in w and r.random() < 0.05:
                row = row[: -len(w)] + w.replace("l", "1", 1) if row.endswith(w) else row
            if len(lines) % 9 == 8:
                n += 1
                put(f"- {n} -", "furniture")
        put(row)
    else:
        for c in "".join(words):
            row += c
            if len(row) == width:
                put(row)
                row = ""
                if len(lines) % 9 == 8:
                    n += 1
                    put(f"第{n}页共3页", "furniture")
        put(row)
        for k in range(2, len(lines)):
            for a, b in CONFUSED.items():
                if a in lines[k] and k + 1 not in kinds and r.random() < 0.1:
                    lines[k] = lines[k].replace(a, b, 1)
                    kinds.setdefault(k + 1, set()).add("misread")
                    break
    if english:
        for k, line in enumerate(lines):
            if "1" in line and not line.startswith("-"):
                kinds.setdefault(k + 1, set()).add("misread")
    return "\n".join(lines), {(k, x) for k, v in kinds.items() for x in v}


def pages(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        english = k % 2 == 1
        body = [r.choice(ENGLISH) for _ in range(150)] if english else [r.choice(SENTENCES) for _ in range(14)]
        title = "Freight Manifest" if english else "补充协议"
        out.append((render(r, title, body, english, 52 if english else 24), render(r, "# " + title, body, english, 70 if english else 40)))
    return out


def test_held_out_accuracy():
    train, test = pages(120, 1), pages(30, 2)
    model = S.learn([(a[0], b[0]) for a, b in train])
    repairer = S.Repairer(model)
    hit = found = want = 0
    for a, b in test:
        for text, noise in (a, b):
            got = set(repairer.noise(text))
            hit, found, want = hit + len(got & noise), found + len(got), want + len(noise)
    assert hit >= 0.95 * want and hit >= 0.95 * found


def test_repaired_text():
    train = pages(120, 1)
    repairer = S.Repairer(S.learn([(a[0], b[0]) for a, b in train]))
    got = repairer.repaired("补充协议\n供货方应逐项补正原始行程单与登机凭\n证，并以最近一次签收的版本为准；\n第2页共3页\n保管部门当面有权补正免赔额度的计算过程，双亐对此均无异议。")
    assert got == "补充协议\n\n供货方应逐项补正原始行程单与登机凭证，并以最近一次签收的版本为准；保管部门当面有权补正免赔额度的计算过程，双方对此均无异议。"
    assert repairer.repaired("") == "" and repairer.noise("") == []


def test_untrained_marks_page_numbers_only():
    repairer = S.Repairer(S.learn([]))
    assert repairer.noise("题\n正文\n- 1 -\n双亐") == [(3, "furniture")]


def test_frame(spark):
    rows = [(k, a[0], b[0], "z") for k, (a, b) in enumerate(pages(8, 3))] + [(90, None, "", "z"), (91, "只有原文，另一份无。", None, "z")]
    df = spark.createDataFrame(rows + rows[:2], "doc_id bigint, raw_text string, markdown string, noise string")
    texts = df.selectExpr("doc_id", "raw_text as text").where("length(text) > 0")
    model = S.train_model(df, 5)
    assert S.find_noise(texts, model).count() == 11 and S.repair(texts, model).where("doc_id = 91").head().repaired == "只有原文，另一份无。"
    assert S.find_noise(texts.limit(0), S.train_model(df.limit(0))).count() == 0


def test_lines_with_commas_are_classified():
    lines = ["示例置业有限公司，借款合同", "", *(["供货方应逐项补正原始行程单，并以最近一次签收的版本为准；"] * 6), "示例置业有限公司，借款合同，第3页", "其余照旧。"]
    assert all(S.line_features(lines)[i] for i in (2, 8, 9))


def test_giving_up_early_changes_nothing():
    """Every line gets the label that all its features give."""
    r = random.Random(7)
    pages = [render(r, "房屋租赁合同 编号 778", [r.choice(SENTENCES) for _ in range(9)], False, 31)[0] for _ in range(40)]
    pairs = list(zip(pages, [p.replace("- ", "-") for p in pages[1:]]))
    data = [(f, "F" if S.PAGE.fullmatch(x.strip()) or r.random() < 0.02 else "K") for p, _ in pairs for x, f in zip(p.split("\n"), S.line_features(p.split("\n"))) if f]
    w = S.Perceptron(("K", "F")).train(data, 5)
    model = S.FurnitureModel(w.w)
    for p, _ in pairs:
        lines = p.split("\n")
        for i, f in enumerate(S.line_features(lines)):
            if f:
                s = w.score(f)
                assert model.is_furniture(S.Lines(lines), i) == (s.get("F", 0.0) - s.get("K", 0.0) > 1e-9)


def test_numbers_are_decided_as_with_all_features():
    r = random.Random(9)
    texts = ["".join(r.choice("0123456789") for _ in range(r.randrange(1, 12))) for _ in range(400)]
    data = [(S.token_features("", t, "", k, {}), "R:O" if c == "0" and t[k + 1 : k + 2] == "7" else "K") for t in texts for k, c in enumerate(t)]
    editor = S.Perceptron(("K",)).train(data, 6)
    model = {"furniture": {}, "editor": {f: x for f, x in editor.w.items() if not f.startswith("w")}, "breaks": {}, "words": {}, "suspects": list("0123456789")}
    repairer = S.Repairer(model)
    for t in ["".join(r.choice("0123456789") for _ in range(r.randrange(1, 14))) for _ in range(300)]:
        for k in range(len(t)):
            assert repairer.token_edit("", t, "", k) == repairer.editor.predict(S.token_features("", t, "", k, {}))
