"""A text provider without a model, whose answers follow from the prompts; for queries and tests of what is done with answers."""

from __future__ import annotations

import hashlib
import json
import re


def _mark(s: str) -> str:
    return hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()


class Canned:
    """Answers by the md5 of what is asked about: some well-formed, some cut off or broken, some with ordinals left out."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.one(*p.split("\n", 1)) for p in prompts]

    def one(self, head: str, rest: str = "") -> str:
        if head.startswith("提取题目"):
            return self.records(_mark(rest))
        if head.startswith("补题"):
            numbers, text = rest.split("\n", 1)
            items = [{"content": f"{n}. 补回的题目，已知函数f(x)的值，求证：{_mark(text)}", "difficulty": int(n) % 7} for n in numbers.split(",") if int(n) % 2 == 0]
            return json.dumps([*items, {"content": f"199. {rest[:9]}不在其中的题目"}], ensure_ascii=False)
        if head.startswith("返回JSON元数据"):
            m = _mark(rest)
            return "好的 " + json.dumps({"region": "青坡市" if m[0] < "8" else "", "year": str(2000 + int(m[1], 16)) if m[2] < "8" else "不详", "grade": "初三"}, ensure_ascii=False)
        if head.startswith("题型？"):
            return {"0": "这是选择题", "1": "填空", "2": "证明题"}.get(_mark(rest)[0], "？")
        if head.startswith("是否"):
            return {"0": "是", "1": "否"}.get(_mark(rest)[0], "")
        out = []
        for line in rest.split("\n"):
            at, item = line.split("\t", 1)
            m = _mark(item)
            if m[0] > "3":
                out.append({"index": int(at), "question_type": "填空题" if m[1] < "8" else "证明题", "is_instruction": m[1] < "4", "knowledge_points": ["函数", " ", m[2]], "difficulty": int(m[3], 16) % 8})
        return "```json\n" + json.dumps(out, ensure_ascii=False) + "\n```"

    def records(self, m: str) -> str:
        one = json.dumps({"content": f"1. 已知函数f(x)的值为{m}，求f(x)", "question_type": "选择题" if m[1] < "4" else "", "knowledge_points": "函数、值", "difficulty": str(int(m[2], 16) % 7)}, ensure_ascii=False)
        two = re.sub(r"1\. 已知", "2. 若", one, count=1)
        kind = int(m[0], 16) % 3
        return f"```json\n[{one},]\n```" if kind == 0 else f"[{one}, " if kind == 1 else f"[{one}, {{oops}}, {two}]"
