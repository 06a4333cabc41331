"""Records as documents: Markdown sections and HTML sheets, rendered as string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET_STYLE = "<style>body{max-width:46rem;margin:2rem auto;line-height:1.7}h1{font-size:1.4rem}.question{border-top:1px solid #ccc}.answer{border-left:3px solid #888;padding-left:.6rem}</style>"


def _given(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", x)


def section(parts: DataFrame, part: str, title: str, label: str) -> DataFrame:
    """(part, body): the rows of one part, numbered, as a Markdown section."""
    item = F.format_string(f"**{label}%d** （难度 %d/5）\n%s", F.col("number"), F.coalesce("difficulty", F.lit(3)), F.coalesce("content", F.lit("")))
    rows = parts.where(F.col("part") == part).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("number", item.alias("t")))).alias("p"))
    return rows.select("part", F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform("p", lambda p: p["t"]), "\n\n")).alias("body"))


def handout(parts: DataFrame, title: str) -> DataFrame:
    """(markdown): a title, the examples and the practice."""
    both = section(parts, "example", "例题", "例").unionByName(section(parts, "practice", "练习", "练习"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "body"))), lambda p: p["body"]), "\n\n")
    return both.agg(F.concat(F.lit(f"# {title}\n\n"), body).alias("markdown"))


def markdown_html(x: Column) -> Column:
    """The Markdown that this package writes as HTML: headings of three levels, paragraphs, bold words and line breaks. NULL for NULL."""
    bold = lambda s: F.regexp_replace(s, r"\*\*([^*]+)\*\*", "<b>$1</b>")

    def block(s: Column) -> Column:
        out = F.concat(F.lit("<p>"), F.regexp_replace(bold(s), r"\n", "<br>"), F.lit("</p>"))
        for n in (1, 2, 3):
            mark = "#" * n + " "
            out = F.when(s.startswith(mark), F.concat(F.lit(f"<h{n}>"), bold(F.substr(s, F.lit(n + 2))), F.lit(f"</h{n}>"))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(x, r"\n{2,}"), lambda s: s != ""), block), "\n")


def sheet_item(number: Column, content: Column, images: Column, answer: Column, solution: Column, answers: bool) -> Column:
    """A record of a sheet as HTML. Missing images, answer and solution leave nothing."""
    shown = F.transform(F.filter(F.coalesce(images, F.array().cast("array<string>")), lambda p: p.isNotNull() & (p != "")), lambda p: F.concat(F.lit('<img src="'), p, F.lit('" class="question-image" alt="题目图片" />')))
    pictures = F.when(F.size(shown) > 0, F.concat(F.lit('<div class="image-container">'), F.array_join(shown, ""), F.lit("</div>")))
    out = [F.format_string('<div class="question"><h3>第%d题</h3><p>%s</p>', number, F.coalesce(content, F.lit(""))), F.coalesce(pictures, F.lit(""))]
    for name, x in (("答案", answer), ("解析", solution)) if answers else ():
        out.append(F.coalesce(F.concat(F.lit(f'<div class="answer"><strong>{name}：</strong>'), _given(x), F.lit("</div>")), F.lit("")))
    return F.concat(*out, F.lit("</div>"))


def sheets(rows: DataFrame, sheet: str = "sheet_id", at: str = "row_id", answers: bool = False, title: str = "作业") -> DataFrame:
    """(sheet, n, html): each sheet's records in order of `at`, numbered from 1, as one HTML page. A sheet is what one page
    holds, so its records are few."""
    one = rows.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct(at, "content", "images", "answer", "solution"))).alias("r"))
    items = F.transform("r", lambda r, i: sheet_item(i + 1, r["content"], r["images"], r["answer"], r["solution"], answers))
    html = F.concat(F.lit(f"<html><head><meta charset='utf-8'>{SHEET_STYLE}</head><body><h1>{title}</h1>"), F.array_join(items, ""), F.lit("</body></html>"))
    return one.select(sheet, F.size("r").alias("n"), html.alias("html"))
