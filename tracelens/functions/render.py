"""What a model is shown of search results: XML built by Column expressions, and the judge's prompt around it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelens.functions.templates import escape, render

#: The members of a page that its XML names, in order.
PAGE_MEMBERS = ["fetch_backend", "fetch_status", "http_status", "content_type", "extractor", "artifact_path", "final_url", "extracted_text_chars", "extracted_text_tokens_estimate"]


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _tag(name: str, value: Column, indent: int) -> Column:
    return F.concat(F.lit(f"{' ' * indent}<{name}>"), escape(value), F.lit(f"</{name}>"))


def page_xml(page: Column) -> Column:
    """The page that was fetched; '' without one."""
    whole = _lines(F.lit("    <extracted_page>"), *[_tag(m, page[m], 6) for m in PAGE_MEMBERS], F.lit("      <content>"), escape(page["extracted_text"]), F.lit("      </content>"), F.lit("    </extracted_page>"))
    return F.when(page.isNull(), "").otherwise(whole)


def document_xml(result: Column, extra: Column, with_page: bool = True) -> Column:
    """One search result: document_id, rank, title, url, domain, snippet, its extra snippets and its page."""
    shown = F.when(F.coalesce(result["document_id"], F.lit("")) != "", result["document_id"]).otherwise(F.concat(F.lit("rank_"), F.coalesce(result["rank"].cast("string"), F.lit("None"))))
    more = F.array_join(F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda s: F.concat(F.lit("    <extra_snippet>"), escape(s), F.lit("</extra_snippet>"))), "\n")
    head = F.concat(F.lit('\n  <document id="'), escape(shown), F.lit('" rank="'), escape(result["rank"]), F.lit('">'))
    return _lines(head, _tag("document_id", shown, 4), *[_tag(m, result[m], 4) for m in ("title", "url", "domain", "snippet")], more, page_xml(result["page_fetch"]) if with_page else F.lit(""), F.lit("  </document>\n"))


def documents_xml(query: Column, provider: Column, results: Column, extra: Callable[[Column], Column], with_page: bool = True) -> Column:
    """A search's results as the model sees them."""
    return search_xml(query, provider, F.array_join(F.transform(results, lambda r: document_xml(r, extra(r), with_page)), ""))


def search_xml(query: Column, provider: Column, documents: Column) -> Column:
    """The same around the text of its documents."""
    head = F.concat(F.lit('<search_documents>\n<search query="'), escape(query), F.lit('" provider="'), escape(provider), F.lit('">\n'))
    return F.concat(head, documents, F.lit("\n</search>\n</search_documents>"))


def fetched_xml(page: Column, url: Column, source: dict[str, Column]) -> Column:
    """A page that the model asked for, with where it had been seen."""
    named = {"url": url, "source_document_id": source["document_id"], "source_retrieval_id": source["retrieval_id"], "source_rank": source["rank"], "title": source["title"], "domain": source["domain"], "snippet": source["snippet"]}
    members = ["fetch_backend", "final_url", "reader_url", "fetch_status", "http_status", "content_type", "extractor", "artifact_path", "extracted_text_chars", "extracted_text_tokens_estimate"]
    return _lines(F.lit("<fetched_page>"), *[_tag(n, c, 2) for n, c in named.items()], *[_tag(m, page[m], 2) for m in members], F.lit("  <content>"), escape(page["extracted_text"]), F.lit("  </content>"), F.lit("</fetched_page>"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template's text, of values that are text."""
    return render(template, {n: (c, StringType()) for n, c in values.items()})


def capped(page: Column, limit: int) -> tuple[Column, Column]:
    """The page's text cut to limit characters (0: whole), and whether it was."""
    text = F.coalesce(page["extracted_text"], F.lit(""))
    cut = F.lit(limit > 0) & (F.length(text) > limit)
    return F.when(cut, F.substring(text, 1, max(limit, 0))).otherwise(text), cut


def judge_prompt(template: str, values: dict[str, Column | Callable[[Column], Column]], page: Column, limit: int = 0) -> tuple[Column, Column]:
    """The messages (role, content) that the judge gets, and whether the page was cut.

    values hold the document's XML too; one that depends on the page is a function of it, and gets the page as it was cut.
    """
    text, cut = capped(page, limit)
    shown = F.when(cut, page.withField("extracted_text", text)).otherwise(page) if limit > 0 else page
    known = {n: v(shown) if callable(v) and not isinstance(v, Column) else v for n, v in values.items()}
    content = fill(template, known | {"text_truncated": F.when(cut, "true").otherwise("false")})
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit("You are a precise JSON-only evaluation judge.")), message("user", content)), cut
