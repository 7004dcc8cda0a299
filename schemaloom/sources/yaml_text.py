"""The part of YAML that schema files use: mappings, sequences, scalars, flow collections, block scalars, comments."""

from __future__ import annotations

import json
import re

from schemaloom.functions.errors import SchemaError

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
# Plain scalars that are no strings.
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def _bare(line: str) -> str:
    """Without a comment that begins outside quotes."""
    quote = ""
    for i, ch in enumerate(line):
        if quote:
            quote = "" if ch == quote and line[i - 1] != "\\" else quote
        elif ch in "'\"" and (i == 0 or line[i - 1] in " [{,:-"):
            quote = ch
        elif ch == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _scalar(text: str):
    text = text.strip()
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] in "[{" and text:
        value, rest = _flow(text)
        if rest.strip():
            raise SchemaError("text behind a flow collection", text=rest)
        return value
    if text in _WORDS:
        return _WORDS[text]
    if re.fullmatch(r"[-+]?\d+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def _flow(text: str):
    """(value, rest) of [a, b], {a: b} or a scalar inside one of them."""
    text = text.lstrip()
    if text[:1] in "[{" and text:
        close, out, rest = ("]", [], text[1:]) if text[0] == "[" else ("}", {}, text[1:])
        while True:
            rest = rest.lstrip()
            if not rest:
                raise SchemaError("a flow collection does not end", text=text)
            if rest[0] == close:
                return out, rest[1:]
            if rest[0] == ",":
                rest = rest[1:]
            elif close == "]":
                value, rest = _flow(rest)
                out.append(value)
            else:
                key, rest = _flow(rest)
                rest = rest.lstrip()
                value = None
                if rest[:1] == ":":
                    value, rest = _flow(rest[1:])
                out[key] = value
    m = re.match(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,\[\]{}:]*(?::(?=\S)[^,\[\]{}:]*)*)""", text)
    return _scalar(m[1]), text[m.end() :]


class _Reader:
    def __init__(self, text: str):
        self.raw = text.splitlines()
        self.at = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and text of the next line that says something."""
        while self.at < len(self.raw):
            line = _bare(self.raw[self.at])
            if line.strip() and line.strip() not in ("---", "...") and not line.startswith("%"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise SchemaError("a tab indents", line=self.at + 1)
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def block(self, least: int):
        """The node whose lines are indented by `least` or more."""
        head = self.peek()
        if head is None or head[0] < least:
            return None
        indent, text = head
        if text == "-" or text.startswith("- "):
            return self._sequence(indent)
        if _KEY.match(text):
            return self._mapping(indent)
        self.at += 1
        while (more := self.peek()) and more[0] >= least:  # a plain scalar goes on
            text += " " + more[1]
            self.at += 1
        return _scalar(text)

    def _sequence(self, indent: int) -> list:
        out = []
        while (head := self.peek()) and head[0] == indent and (head[1] == "-" or head[1].startswith("- ")):
            inner = head[1][1:]
            if not inner.strip():
                self.at += 1
                out.append(self.block(indent + 1))
            elif _KEY.match(inner.strip()) or inner.strip().startswith("- "):
                # what follows the dash is a node of its own, indented as it stands
                self.raw[self.at] = " " * (indent + 1) + inner
                out.append(self.block(indent + 1))
            else:
                out.append(self._value(inner.strip(), indent))
        return out

    def _mapping(self, indent: int) -> dict:
        out = {}
        while (head := self.peek()) and head[0] == indent and (m := _KEY.match(head[1])):
            key = _scalar(m[1])
            value = head[1][m.end() :].strip()
            if value:
                out[key] = self._value(value, indent)
                continue
            self.at += 1
            below = self.peek()
            if below and (below[0] > indent or below[0] == indent and (below[1] == "-" or below[1].startswith("- "))):
                out[key] = self.block(below[0])
            else:
                out[key] = None
        if (head := self.peek()) and head[0] > indent:
            raise SchemaError("a line that belongs to nothing", line=self.at + 1)
        return out

    def _value(self, text: str, indent: int):
        """A value that begins on the line of its key or dash."""
        if m := re.fullmatch(r"([|>])([-+]?)\d?", text):
            return self._lines(indent, m[1] == "|", m[2])
        self.at += 1
        while text[:1] in "[{" and text.count("[") + text.count("{") > text.count("]") + text.count("}") and self.at < len(self.raw):
            text += " " + _bare(self.raw[self.at]).strip()
            self.at += 1
        if text[:1] not in "[{'\"":
            while (more := self.peek()) and more[0] > indent and not _KEY.match(more[1]) and not more[1].startswith("- "):
                text += " " + more[1]
                self.at += 1
        return _scalar(text)

    def _lines(self, indent: int, literal: bool, chomp: str) -> str:
        self.at += 1
        lines, inner = [], None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            deep = len(line) - len(line.lstrip(" "))
            if line.strip() and deep <= indent:
                break
            if line.strip() and inner is None:
                inner = deep
            lines.append(line[inner or 0 :].rstrip() if line.strip() else "")
            self.at += 1
        while lines and not lines[-1]:
            lines.pop()
        text = "\n".join(lines) if literal else re.sub(r"(?<=\S) (?=\n)|(?<=\S)\n(?=\S)", " ", "\n".join(lines))
        return text + ("" if chomp == "-" or not lines else "\n")


def read_yaml(text: str):
    """The value of the first document of a YAML text."""
    reader = _Reader(text.lstrip("﻿"))
    out = reader.block(0)
    if reader.peek() is not None:
        raise SchemaError("a line that belongs to nothing", line=reader.at + 1)
    return out
