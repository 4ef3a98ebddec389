"""Script and element classification of markup; parsing runs in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Script types that run, and tags that wrap a page.
EXECUTABLE = {"", "application/ecmascript", "application/javascript", "module", "text/ecmascript", "text/javascript"}
WRAPPERS = {"html", "head", "body"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.inline: list[str] = []
        self.external: list[str] = []
        self.dom = False
        self._open: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        if tag == "script":
            if "src" in a:
                self.external += [a["src"].strip()] if a["src"].strip() else []
            elif a.get("type", "").strip().lower() in EXECUTABLE:
                self._open = []
            else:
                self.dom = True
        elif tag not in WRAPPERS:
            self.dom = True

    def handle_data(self, data):
        if self._open is not None:
            self._open.append(data)

    def handle_endtag(self, tag):
        if tag == "script" and self._open is not None:
            self.inline.append("".join(self._open))
            self._open = None


def parse(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    return p


def category(html: str | None) -> str:
    """``empty`` (blank), ``with_dom`` (an element besides scripts that run), ``external_only`` (scripts by reference), else ``inline_only``."""
    if not (html or "").strip():
        return "empty"
    p = parse(html)
    return "with_dom" if p.dom else "external_only" if p.external else "inline_only"


def page_scripts(html: Column) -> Column:
    """Category, numbers of inline and external scripts, and characters of inline code."""
    # made at call time: a module can be imported before there is a session
    return F.pandas_udf(_scripts, "struct<category:string,n_inline:long,n_external:long,inline_chars:long>")(html)


def markup_nodes(html: Column) -> Column:
    """Flat preorder nodes of a page's elements."""
    return F.pandas_udf(_nodes, "array<struct<idx:int,begin:int,name:string,parent_idx:int,subtree_end:int>>")(html)


def _scripts(html: pd.Series) -> pd.DataFrame:
    rows = []
    for h in html:
        p = parse(h)
        rows.append((category(h), len(p.inline), len(p.external), sum(map(len, p.inline))))
    return pd.DataFrame(rows, columns=["category", "n_inline", "n_external", "inline_chars"])


def _nodes(html: pd.Series) -> pd.Series:
    """Void and unclosed tags end with their parent."""
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    class Tree(HTMLParser):
        def __init__(self) -> None:
            super().__init__()
            self.nodes, self.stack, self.lines = [], [], [0]

        def handle_starttag(self, tag, attrs):
            line, col = self.getpos()
            self.nodes.append((len(self.nodes), self.lines[line - 1] + col, tag, self.stack[-1][0] if self.stack else -1))
            if tag not in void:
                self.stack.append((len(self.nodes) - 1, tag))

        def handle_endtag(self, tag):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][1] == tag:
                    del self.stack[k:]
                    break

    out = []
    for h in html:
        t = Tree()
        text = h or ""
        for line in text.split("\n"):
            t.lines.append(t.lines[-1] + len(line) + 1)
        t.feed(text)
        last = list(range(len(t.nodes)))
        for a, _, _, up in reversed(t.nodes):
            if up >= 0:
                last[up] = max(last[up], last[a])
        out.append([{"idx": a, "begin": b, "name": c, "parent_idx": d, "subtree_end": last[a]} for a, b, c, d in t.nodes])
    return pd.Series(out)
