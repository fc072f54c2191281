"""Small helpers for wiki text inside tasks: what a reader sees of a page, and its words."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|hr|blockquote|center|poem|h[1-6])\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"''+")
_MEDIA = re.compile(r"\[\[\s*(?:File|Image|Datei|Fichier|Archivo)\s*:[^\[\]|]*((?:\|[^\[\]|]*)*)\]\]", re.I)
_CATEGORY = re.compile(r"\[\[\s*(?:Category|Kategorie|Cat[eé]gorie|Categor[ií]a)\s*:[^\[\]]*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_WEB = re.compile(r"\[(?:https?:)?//[^\s\[\]]*\s*([^\[\]]*)\]")
_TEMPLATE_NAME = re.compile(r"\{\{[^{}|\n]*")
_PARAMETER = re.compile(r"\|\s*[\w .\-]{1,40}?\s*=(?!=)")
_TABLE_START = re.compile(r"^\s*\{\|.*$", re.M)
_ROW = re.compile(r"^\s*\|[-+].*$", re.M)
_CELL_STYLE = re.compile(r"(\|\|?|!!?)\s*(?:[a-z]+\s*=\s*(?:\"[^\"\n]*\"|'[^'\n]*'|[^\s|\"']+)\s*)+\|(?!\|)")
_MARKS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯­͏؜᠎​-‏‪-‮⁠-⁯﻿]+")
_WORD = re.compile(r"[^\W_]+")
_TO_BLANK = {i: " " for i in range(128) if not chr(i).isalnum()}

_INNER_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}")
_TABLE = re.compile(r"^[ \t:]*\{\|(?:(?!^[ \t:]*\{\|).)*?^[ \t]*\|\}", re.S | re.M)
_HEADING = re.compile(r"^=+[^\n]*=+[ \t]*$", re.M)


def _caption(m: re.Match) -> str:
    last = m[1].rpartition("|")[2]
    return " " if re.fullmatch(r"\s*(?:\d+\s*px|thumb|thumbnail|left|right|center|frame|frameless|)\s*", last) else f" {last} "


def _inline(text: str) -> str:
    """Without comments, references, tags and link targets; what they surround stays in its place."""
    if "<" in text:
        text = _COMMENT.sub("", text)
        text = _REF.sub("", text)
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "[" in text:
        if ":" in text:
            text = _CATEGORY.sub(" ", text)
            text = _MEDIA.sub(_caption, text)
        text = _LINK.sub(r"\1", text)
        text = _LINK.sub(r"\1", text)
        if "//" in text:
            text = _WEB.sub(r"\1", text)
    return text


def _folded(text: str) -> str:
    """Lower case without accents and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()
    else:
        text = text.lower()
    return text


def _words(folded: str) -> list[str]:
    # the translation is several times faster than the pattern, and gives the same words
    return folded.translate(_TO_BLANK).split() if folded.isascii() else _WORD.findall(folded)


def visible_words(text: str) -> list[str]:
    """Folded words of all that is visible, table cells and template parameters included."""
    text = _inline(text)
    if "{|" in text:
        text = _ROW.sub(" ", _TABLE_START.sub(" ", text))
    if "{{" in text:
        text = _TEMPLATE_NAME.sub(" ", text)
    if "|" in text and "=" in text:
        text = _PARAMETER.sub(" ", _CELL_STYLE.sub(r"\1 ", text))
    return _words(_folded(text))


def plain_words(text: str) -> list[str]:
    """Folded words of a text without markup."""
    return _words(_folded(text))


def prose_paragraphs(text: str) -> list[list[str]]:
    """Folded words of each paragraph of running text, outside templates, tables, lists, headings and markup."""
    if "<" in text:
        text = _COMMENT.sub("", text)
        text = _REF.sub("", text)
    while "{{" in text:
        less = _INNER_TEMPLATE.sub(" ", text)
        if less == text:
            break
        text = less
    while "{|" in text:
        less = _TABLE.sub("\n", text)
        if less == text:
            break
        text = less
    if "[" in text and ":" in text:
        text = _MEDIA.sub(" ", _CATEGORY.sub(" ", text))
    text = _inline(text)
    if "==" in text:
        text = _HEADING.sub("\n", text)
    lines = (line for line in _folded(text).split("\n") if line and line.lstrip()[:1] not in ("*", "#", "|", "!", ";", "{", "}"))
    return [words for line in lines if (words := _words(line))]
