"""Leaf blocks of a page: runs of text between block-level borders, each with its open tags."""

from __future__ import annotations

import html
import re

BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr "
                  "ul label iframe object video audio canvas textarea svg template head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())       # their content is no markup
GONE = frozenset("script style title noscript iframe template svg annotation annotation-xml head textarea select option object video audio canvas datalist xmp noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head".split())      # all else ends a head that is open
CLOSES_P = BLOCK - frozenset("button label option optgroup body html noscript iframe object video audio canvas textarea svg math template head title select".split())
OWN = {"li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"),
       "option": ("option", "select"), "thead": ("thead tbody tfoot", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
OWN = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in OWN.items()}
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|</[^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Open:
    """An open element: tag, words of its class, id, role and label, and whether it is shown."""
    __slots__ = ("tag", "names", "shown")

    def __init__(self, tag: str, attributes: str, above: bool):
        self.tag, self.names, self.shown = tag, (), above and tag not in GONE
        if attributes and tag not in ("a", "b", "i", "em", "strong"):
            names = []
            for k, *v in NAMED.findall(attributes):
                v, k = "".join(v), k.lower()
                if k == "style":
                    self.shown &= not re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I)
                elif k in ("hidden", "aria-hidden"):
                    self.shown &= k == "aria-hidden" and v.lower() != "true"
                else:
                    names += [x.lower() for x in PART.findall(v)]
            self.names = tuple(names)


class Block:
    """Text of a leaf block, its open elements, and how many of its characters are links."""
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple, linked: int):
        self.text, self.path, self.linked = text, path, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """The shown leaf blocks of a page in page order.  Tags may be missing, crossed or cut off."""
    out: list[Block] = []
    stack: list[Open] = []
    held: list[str] = []
    linked, at, page = 0, 0, page or ""

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            out.append(Block(text, tuple(stack), min(linked, len(text))))
        held.clear()
        linked = 0

    def close(upto: int) -> None:
        if any(x.tag in BLOCK for x in stack[upto:]):
            flush()
        del stack[upto:]

    while at < len(page):
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if stack and stack[-1].tag == "head" and page[at:end].strip():
            close(len(stack) - 1)
        if end > at and (not stack or stack[-1].shown):
            held.append(page[at:end])
            if any(x.tag == "a" for x in stack):
                linked += len(page[at:end].strip())
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if k is not None and not (tag not in BLOCK and any(x.tag in BLOCK for x in stack[k + 1:])):
                close(k)
            elif tag == "p":
                flush()
            continue
        if not m[4]:
            break                                   # a tag that the page's end cuts off
        if stack and stack[-1].tag == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag == "br":
            held.append(" ")
        if tag in BLOCK:
            if tag in CLOSES_P:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == "p"), None)
                if k is not None:
                    close(k)
            if tag in OWN:
                mine, within = OWN[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in mine:
                        close(k)
                        break
            flush()
        if tag in VOID:
            continue
        if tag in RAW:
            e = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = e.end() if e else len(page)
            continue
        stack.append(Open(tag, m[3], not stack or stack[-1].shown))
    flush()
    return out
