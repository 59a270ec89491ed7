"""Main text of web pages by union-free wrappers that are inferred per host.

A page is a stream of structural tags and text slots; inline markup belongs to the text, end tags that HTML lets
authors leave out are not part of the stream.  Adjacent equal runs fold into repeated groups.  A host's wrapper
starts as its first stream and is aligned with one stream after the other: tokens that only one side has become
optional, a run against its own repetition becomes a repeated group, texts that differ become slots.  Equal streams
of a host are counted before they are gathered; a host is folded in parts first, then the parts, so a host of a third
of all pages is never in one task, and only distinct streams and slots are shuffled.

A page's slot is content if it lies in an article or main element.  On a page without text in one, a slot is content
if its text differs between the host's distinct pages of that kind or only one of them has it; if no slot is left by
that, all are content.  Slots inside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or
comments are never content; class, id and role of html, body, main and article do not say that.  Extraction reads each
whole page again with its host's wrapper.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.store import Workspace
from veilwork.llm.text import binaries, mix, portions, words

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|object|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# HTML elements by their part in a page.
STRUCTURE = frozenset(
    "html head title body article main section div nav header footer aside form menu dialog fieldset button select "
    "h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption "
    "address details summary hr".split()
)
END_OPTIONAL = frozenset("p li dt dd thead tbody tfoot tr td th".split())
VOID = frozenset(["hr"])
REGION = frozenset(["article", "main"])
NAMED_FOR_PARTS = REGION | {"html", "body"}  # their class, id or role tells what they hold besides the content
WITH = frozenset("with without has no".split())
NO_CONTENT = frozenset("head title nav header footer aside form menu dialog button select".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget cookie cookies consent notice notices newsletter subscribe "
    "popup modal share sharing social related comment comments discussion replies disqus login search toolbar complementary "
    "contentinfo alert form".split()
)


def _key(tag: str, attributes: str) -> str:
    """Tag, marked ``!`` if its own name or its class, id or role says that it holds no content."""
    names = {tag} if tag in NO_CONTENT else set()
    if attributes and tag not in NAMED_FOR_PARTS:
        for found in ATTRIBUTE.finditer(attributes):
            for value in (found[2] or found[3] or found[4] or "").lower().split():
                parts = set(re.split(r"[_-]+", value))
                if not parts & WITH:  # with-sidebar names the page's layout
                    names |= NO_CONTENT_NAMES & parts
    return f"{tag}!" if names else tag


def blocks(html: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The page's stream of tags and slots, and (path, text) of every non-blank text block in page order."""
    stack, stream, found, text, at = [], [], [], [], 0

    def flush() -> None:
        plain = " ".join(unescape("".join(text)).split())
        if plain:
            path = "/".join(stack) or "."
            if not stream or stream[-1] != f"#{path}":  # end tags that may be left out are not in the stream
                stream.append(f"#{path}")
            found.append((path, plain))
        text.clear()

    def close(tag: str) -> None:
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth].rstrip("!") == tag:
                for inner in reversed(stack[depth:]):
                    if inner.rstrip("!") not in END_OPTIONAL:
                        stream.append(f"/{inner}")
                del stack[depth:]
                return

    for token in TOKEN.finditer(html):
        text.append(html[at : token.start()])
        at = token.end()
        tag = (token["tag"] or "").lower()
        if tag == "br" or token["raw"]:
            text.append(" ")
        if tag not in STRUCTURE:
            continue
        flush()
        if token["close"]:
            close(tag)
            continue
        if stack and stack[-1].rstrip("!") == "p":  # a structural element ends an open paragraph
            stack.pop()
        if stack and tag in END_OPTIONAL and stack[-1].rstrip("!") == tag:
            stack.pop()
        key = _key(tag, token["attributes"] or "")
        stream.append(key)
        if tag not in VOID:
            stack.append(key)
    text.append(html[at:])
    flush()
    return stream, found


def fold_repeats(stream: list[str], longest: int = 12) -> list[str]:
    """Adjacent equal runs as groups ``(...)+``, shortest runs first, until nothing repeats."""
    changed = True
    while changed:
        changed = False
        for size in range(1, min(longest, len(stream) // 2) + 1):
            out, i = [], 0
            while i < len(stream):
                run = stream[i : i + size]
                j = i + size
                while stream[j : j + size] == run:
                    j += size
                group = run[0] if size == 1 and run[0].endswith(")+") else f"({' '.join(run)})+"
                if j > i + size:
                    out.append(group)
                    i, changed = j, True
                elif len(out) and out[-1] == group and len(run) == size and group != run[0]:
                    i, changed = j, True  # one more repetition behind a group
                else:
                    out.append(stream[i])
                    i += 1
            stream = out
    return stream


Wrapper = list[tuple[str, bool]]  # token or group, and whether it is optional


def align(left: Wrapper, right: Wrapper) -> Wrapper:
    """The least union-free expression this alignment finds that reads both sides."""
    a, b = [k for k, _ in left], [k for k, _ in right]
    out: Wrapper = []
    for op, i, j, m, n in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [(key, left[i + k][1] or right[m + k][1]) for k, key in enumerate(a[i:j])]
        elif op == "replace" and a[i:j] == [f"({' '.join(b[m:n])})+"]:
            out += left[i:j]
        elif op == "replace" and b[m:n] == [f"({' '.join(a[i:j])})+"]:
            out += right[m:n]
        else:
            out += [(key, True) for key in a[i:j] + b[m:n]]
    kept: Wrapper = []
    for key, optional in out:  # equal optional neighbours say the same
        if not (optional and kept and kept[-1] == (key, True)):
            kept.append((key, optional))
    return kept


def expression(wrapper: Wrapper) -> str:
    return " ".join(f"({key})?" if optional else key for key, optional in wrapper)


def _parsed(text: str) -> Wrapper:
    return [(line[1:], line[0] == "?") for line in text.split("\n")] if text else []


def _fold(frame: pd.DataFrame) -> pd.DataFrame:
    texts = sorted(frame["wrapper"], key=lambda t: (len(t), t))
    whole = _parsed(texts[0])
    for text in texts[1:]:
        whole = align(whole, _parsed(text))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "wrapper": ["\n".join(f"{'?' if o else '.'}{k}" for k, o in whole)]})


def _in_region(path: str) -> bool:
    return not REGION.isdisjoint(path.split("/"))


def _hash(text: str) -> int:
    hashes, _ = words([text.encode()])
    return int(mix(hashes + np.arange(len(hashes), dtype=np.uint64)).sum(dtype=np.uint64) >> np.uint64(1))


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct streams of each host (slot null), and per slot of its pages without text in a region the least and
    largest hash of its text and of the pages that have it, per portion."""
    for batch in batches:
        for rows, texts in portions(batch, "html", 8 << 20):
            streams, slots = set(), {}
            for host, page in zip(rows.column(0).to_pylist(), texts, strict=True):
                stream, found = blocks(page.decode("utf-8", "replace"))
                streams.add((host, "\n".join(f".{k}" for k in fold_repeats(stream))))
                found = [(path, text) for path, text in found if "!" not in path]
                if any(_in_region(path) for path, _ in found):
                    continue
                by_path: dict[str, list[str]] = {}
                for path, text in found:
                    by_path.setdefault(path, []).append(text)
                whole = _hash("\n".join(f"{path}\n{text}" for path, text in found))
                for path, parts in by_path.items():
                    h = _hash("\n".join(parts))
                    low, high, first, last = slots.get((host, path), (h, h, whole, whole))
                    slots[host, path] = (min(low, h), max(high, h), min(first, whole), max(last, whole))
            out = [(h, s, *[None] * 5) for h, s in streams] + [(h, None, p, *v) for (h, p), v in slots.items()]
            kinds = (pa.string(), pa.string(), pa.string(), *[pa.int64()] * 4)
            names = ["host", "wrapper", "slot", "low", "high", "first", "last"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _host(url_column: str):
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host")


def infer(pages: DataFrame, url_column: str = "url", html_column: str = "html", salts: int = 32) -> DataFrame:
    """``host, wrapper, slots`` per host: paths of pages without text in a region, and whether their text differs
    between distinct pages."""
    space = Workspace(pages.sparkSession, "wrappers")
    read = pages.select(_host(url_column), F.col(html_column).cast("string").alias("html"))
    seen = read.mapInArrow(
        _observe, "host string, wrapper string, slot string, low long, high long, first long, last long"
    )
    seen = space.save(seen, "seen")
    streams = seen.where("slot IS NULL").select("host", "wrapper").distinct()
    salted = streams.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    parts = salted.groupBy("host", "salt").applyInPandas(_fold, "host string, wrapper string")
    folded = parts.groupBy("host").applyInPandas(_fold, "host string, wrapper string")
    slots = seen.where("slot IS NOT NULL").groupBy("host", "slot").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    varying = (F.col("low") < F.col("high")) | (F.col("first") == F.col("last"))  # or one distinct page has it
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", varying.alias("varies"))).alias("slots"))
    return space.save(folded.join(slots, "host", "left"), "wrappers")


Paths = tuple[frozenset[str], frozenset[str]]


def content_paths(wrapper: str, slots) -> Paths:
    """The wrapper's slots that may hold content, and those of them whose text differs between pages."""
    paths = frozenset(p for key, _ in _parsed(wrapper) for p in re.findall(r"#([^\s()#]+)", key) if "!" not in p)
    return paths, paths & {s["slot"] for s in slots or () if s["varies"]}


def content(found: list[tuple[str, str]], paths: Paths) -> str:
    """Main text of one page's blocks: those in a region, else those that differ, else all that may hold content."""
    own = [(path, text) for path, text in found if path in paths[0]]
    inside = [text for path, text in own if _in_region(path)]
    return "\n".join(inside or [text for path, text in own if path in paths[1]] or [text for _, text in own])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Paths] = {}
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            out = []
            for host, html, wrapper, slots in zip(
                part.column(2).to_pylist(), binaries(part.column(3)), part.column(4).to_pylist(), part.column(5), strict=True
            ):
                if host not in kept:
                    if len(kept) > 4096:
                        kept.clear()
                    kept[host] = content_paths(wrapper or "", slots.as_py())
                _, found = blocks(html.decode("utf-8", "replace"))
                out.append(content(found, kept[host]))
            yield pa.record_batch(
                [part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row: the main text, blocks joined by a line feed, empty if there is none.

    Null html counts as empty, a url without a host belongs to the host of no name; repeated rows give repeated rows.
    """
    wrappers = infer(pages, url_column, html_column)
    named = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        _host(url_column),
        F.col(html_column).cast("string").alias("html"),
    )
    joined = named.join(wrappers, "host", "left").select("page_id", "url", "host", "html", "wrapper", "slots")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
