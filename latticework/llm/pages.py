"""Operator 6, HTML extraction by site style trees.

The pages of a host are merged into one tree whose element nodes are chains of labels (tag and class;
neighbours of one label are one node). Under a node, each sequence of child labels is a presentation
style and each text of its own is a content feature. With m pages that have the node, styles of shares
p have the importance -sum p log_m p, and content has 1 - the mean over features of the entropy of the
feature over pages, log_m of the number of pages that have it. Importance is composed upwards,
(1 - g^l) * styles + g^l * children for l styles. A node is noise if it and all below it are under
THRESHOLD; noise branches are left out of each page, scripts, styles and comments always. Texts of a noise
branch that at most FEW pages have, and not all that have the chain, are no boilerplate and stay.

The tree is never gathered: pages send one row a feature to a grouped count, and a host's tree holds
one row a distinct chain. Both passes read a page once.

Defined results: a null or empty page has null or empty text; a page without a host is a site of its
own kind with all such pages; one page alone at its host keeps all text; unclosed, stray and crossing
tags are taken as browsers do; text is one line a block, blanks folded; equal pages of a host count once
and each give a row; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import Table, fitting, small

DAMPING, THRESHOLD, FEW = 0.9, 0.9, 2
STYLE, TEXT, SELF = 0, 1, 2

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_BLANK = re.compile(r"\s+")


def parse(page: str) -> list[tuple[str, str, int, int]]:
    """Events of a page in order: (chain, text, parent's number, own number) for each element opened
    (text None) and each text met."""
    events: list = [("", None, -1, 0)]
    stack: list[tuple[str, str, int]] = [("", "", 0)]  # tag, chain, number
    at, number = 0, 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            tag, chain, own = stack[-1]
            events.append((chain, entities.unescape(piece) if "&" in piece else piece, -1, own))

    def close(upto: int) -> None:
        del stack[max(1, upto) :]

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in _INLINE and stack[i][0] not in _INLINE:
                    break
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        elif tag in _ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in _ENDS[tag]:
                    break
        attributes = m.group(4)
        label = tag
        if attributes and (c := _CLASS.search(attributes)):
            label = tag + "." + ".".join(sorted((c.group(1) or c.group(2) or c.group(3) or "").split()))
        number += 1
        chain = stack[-1][1] + ">" + label
        events.append((chain, None, stack[-1][2], number))
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            stack.append((tag, chain, number))
    text(page[at:])
    return events


def text_hash(chain: str, text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(f"{chain}\0{_BLANK.sub(' ', text).strip()}".encode("utf-8", "surrogatepass"))


def feature_rows(page: str) -> set[tuple[str, int, int]]:
    """(chain, kind, feature hash) of a page, each once."""
    import xxhash

    hash_ = xxhash.xxh64_intdigest
    rows: set = set()
    children: dict[int, list[str]] = {}
    chains: dict[int, str] = {}
    for chain, text, parent, own in parse(page):
        if text is not None:
            rows.add((chain, TEXT, text_hash(chain, text)))
            continue
        chains[own] = chain
        rows.add((chain, SELF, 0))
        if parent >= 0:
            label, line = chain[len(chains[parent]) + 1 :], children.setdefault(parent, [])
            if not line or line[-1] != label:
                line.append(label)
    for own, chain in chains.items():
        rows.add((chain, STYLE, hash_(">".join(children.get(own, ())).encode("utf-8", "surrogatepass"))))
    return rows


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for host, page, copies in zip(*(c.to_pylist() for c in batch.columns)):
            for row in feature_rows(page):
                total[host, *row] += 1 / copies
        host, chain, kind, feature = zip(*total) if total else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(host, type=pa.string()), pa.array(chain, type=pa.string()), pa.array(kind, type=pa.int32()), pa.array(np.array(feature, dtype=np.uint64).view(np.int64)), pa.array(list(total.values()), type=pa.float64())],
            names=["host", "chain", "kind", "feature", "pages"],
        )


def importance(tree: pd.DataFrame) -> pd.DataFrame:
    """tree: one host's chains with m, styles, style_h, texts, text_h. Gives the chains of noise
    branches, and whether a branch is left out from there."""
    tree = tree.sort_values("chain", key=lambda c: -c.str.count(">"), kind="stable")
    below: dict[str, list[float]] = {}
    loud: dict[str, bool] = {}
    value: dict[str, float] = {}
    for r in tree.itertuples():
        kids = below.get(r.chain, [])
        parts = kids + ([1 - r.text_h] if r.texts else [])
        if r.m < FEW:
            own = 1.0
        elif not kids:
            own = 1 - r.text_h if r.texts else min(1.0, r.style_h)
        else:
            g = DAMPING**r.styles
            own = (1 - g) * min(1.0, r.style_h) + g * sum(parts) / len(parts)
        value[r.chain] = own
        # content of its own counts as something below
        heard = loud.get(r.chain, False) or own >= THRESHOLD or any(p >= THRESHOLD for p in parts[len(kids) :])
        loud[r.chain] = heard
        if r.chain:
            up = r.chain[: r.chain.rindex(">")]
            below.setdefault(up, []).append(own)
            loud[up] = loud.get(up, False) or heard
    quiet = [c for c in value if not loud[c]]
    tops = [not c or loud.get(c[: c.rindex(">")], True) for c in quiet]
    return pd.DataFrame({"host": [tree["host"].iloc[0]] * len(quiet), "chain": quiet, "top": tops}, dtype=object)


def extract(page: str, noise: frozenset, common: frozenset = frozenset()) -> tuple[str, int]:
    """(text without what is common in the noise branches, number of noise branches)."""
    lines: list[str] = []
    line: list[str] = []
    out: set[int] = set()
    removed, last = 0, None
    for chain, text, parent, own in parse(page):
        if text is None:
            if parent in out or chain in noise:
                removed += parent not in out
                out.add(own)
            if chain[chain.rfind(">") + 1 :].split(".")[0] not in _INLINE and line:
                lines.append("".join(line))
                line = []
        elif own not in out or np.uint64(text_hash(chain, text)).view(np.int64) not in common:
            block = own if chain[chain.rfind(">") + 1 :].split(".")[0] not in _INLINE else None
            if block is not None and last is not None and block != last and line:
                lines.append("".join(line))
                line = []
            last = block if block is not None else last
            line.append(text)
    lines.append("".join(line))
    folded = (_BLANK.sub(" ", x).strip() for x in lines)
    return "\n".join(x for x in folded if x), removed


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, host, text, removed), a row a row of pages."""
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    # two seeds, 128 bits
    keyed = own.where("html is not null").withColumns({"d1": F.xxhash64("html"), "d2": F.xxhash64(F.lit(1), "html")})
    again = keyed.groupBy("host", "d1", "d2").agg(F.count("*").alias("copies")).where("copies > 1")
    again = Table(again.select(*(F.col(c).alias(f"{c}_") for c in ("host", "d1", "d2")), "copies"))
    same = (F.col("host") == F.col("host_")) & (F.col("d1") == F.col("d1_")) & (F.col("d2") == F.col("d2_"))
    keyed = keyed.join(small(again.df, again.df.count()), same, "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    counted = keyed.mapInArrow(_count, "host string, chain string, kind int, feature long, pages double")
    # shares of equal pages add up to whole pages
    counted = Table(counted.groupBy("host", "chain", "kind", "feature").agg(F.round(F.sum("pages")).cast("long").alias("pages")))
    again.drop()
    m = counted.df.where(F.col("kind") == SELF).select("host", "chain", F.col("pages").alias("m"))
    c = counted.df.where(F.col("kind") != SELF).join(m, ["host", "chain"])
    log_m = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    p = F.col("pages") / F.col("m")
    style, text = F.col("kind") == STYLE, F.col("kind") == TEXT
    # counts of a style may pass m where a page has several such nodes
    tree = c.groupBy("host", "chain", "m").agg(
        F.sum(F.when(style, 1).otherwise(0)).alias("styles"),
        F.coalesce(F.sum(F.when(style, F.greatest(F.lit(0.0), -p * F.log(p) / log_m))), F.lit(0.0)).alias("style_h"),
        F.sum(F.when(text, 1).otherwise(0)).alias("texts"),
        F.coalesce(F.avg(F.when(text, F.log(F.col("pages").cast("double")) / log_m)), F.lit(0.0)).alias("text_h"),
    )
    quiet = Table(tree.groupBy("host").applyInPandas(importance, "host string, chain string, top boolean"))
    tops = quiet.df.where("top").groupBy("host").agg(F.sort_array(F.collect_list("chain")).alias("noise"))
    texts = c.where(text & ((F.col("pages") > FEW) | (F.col("pages") >= F.col("m"))))
    common = texts.join(quiet.df, ["host", "chain"], "left_semi").groupBy("host").agg(F.collect_list("feature").alias("common"))
    noise = Table(tops.join(common, "host", "left"))
    quiet.drop()
    counted.drop()
    chains = F.aggregate("noise", F.lit(0).cast("long"), lambda n, chain: n + F.octet_length(chain))
    noisy = fitting(noise, "host", chains, 8 * F.size(F.coalesce("common", F.array().cast("array<bigint>")))).withColumnRenamed("host", "host_")
    joined = own.join(noisy, F.col("host") == F.col("host_"), "left").select("page_id", "host", "html", "noise", "common")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for page, noise, common in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                found = (None, None) if page is None else extract(page, frozenset(noise or ()), frozenset(common or ()))
                texts.append(found[0])
                removed.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array(removed, type=pa.int64())], names=["page_id", "host", "text", "removed"])

    return joined.mapInArrow(run, "page_id long, host string, text string, removed long")
