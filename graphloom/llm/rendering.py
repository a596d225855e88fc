"""Wiki text as a reader of the rendered page sees it, and its words."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOTE = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_LITERAL = re.compile(r"<nowiki>(.*?)</nowiki>", re.S | re.I)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_ARGUMENT = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TABLE_LINE = re.compile(r"^\s*(?:\{\||\|-|\|\}).*$", re.M)
_CELL = re.compile(r"^\s*[|!]\s*(?:[\w-]+\s*=\s*(?:\"[^\"]*\"|[^\s|]+)\s*)+\|(?!\|)", re.M)
# namespaces whose links show nothing (fixed values)
_HIDDEN = re.compile(r"\[\[\s*(?:Category|Kategorie|Catégorie|Categoría|Категория|カテゴリ)\s*:[^\[\]]*\]\]", re.I)
_MEDIA = re.compile(r"\[\[\s*(?:File|Image|Datei|Bild|Fichier|Archivo|Файл|ファイル)\s*:[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_OUTSIDE = re.compile(r"\[(?:https?:|ftp:)?//[^\s\]]+\s*([^\]]*)\]")
_QUOTES = re.compile(r"'{2,5}")
_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|small|big|sub|sup|span|font|tt|code|abbr|cite|q|mark|del|ins|kbd|var|nowiki|bdi|wbr|strike)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SWITCH = re.compile(r"__[A-Z]+__")
_ZERO = re.compile("[­​‌‍⁠﻿‎‏]")
_WORD = re.compile(r"[^\W_]+")


def _caption(m: re.Match) -> str:
    last = m.group(1).rsplit("|", 1)[-1]
    return f" {last} " if " " in last.strip() else " "


def visible(text: str) -> str:
    """The text without comments, notes, templates, link targets and formatting; entities resolved."""
    if "<!--" in text:
        text = _COMMENT.sub("", text)
    if "<" in text:
        text = _NOTE.sub("", text)
        text = _LITERAL.sub(lambda m: m.group(1).translate({123: 32, 125: 32, 91: 32, 93: 32, 39: 32}), text)
    if "{{" in text:
        text = _ARGUMENT.sub(" ", text)
        before = None
        while before != text:
            before, text = text, _TEMPLATE.sub(" ", text)
    if "|" in text:
        text = _CELL.sub(" ", _TABLE_LINE.sub(" ", text))
    if "[" in text:
        if "[[" in text:
            before = None
            while before != text:  # captions hold links of their own
                before, text = text, _LINK.sub(_label, _MEDIA.sub(_caption, _HIDDEN.sub(" ", text)))
        text = _OUTSIDE.sub(r"\1", text)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "__" in text:
        text = _SWITCH.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def _label(m: re.Match) -> str:
    return m.group(1) if "[[" not in m.group(1) else m.group(0)


def words(text: str) -> list[str]:
    """Runs of letters and digits without case and accents."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _ZERO.sub("", text))
        if not text.isascii():
            text = "".join([c for c in text if not unicodedata.combining(c)])
        text = text.casefold()
    else:
        text = text.lower()
    return _WORD.findall(text)
