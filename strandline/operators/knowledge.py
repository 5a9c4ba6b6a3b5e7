"""Notes on symbols and sections of decisions: small tables, rewritten as a whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from pathlib import Path

#: The longest note or section, and the most sections.
MOST_CHARS, MOST_SECTIONS = 8_000, 50


def _now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Note:
    id: int
    symbol_id: str
    text: str
    created: str


@dataclass
class Section:
    title: str
    content: str
    created: str
    updated: str


@dataclass
class Knowledge:
    """What readers add to a graph, kept in one JSON file beside it."""

    path: Path
    notes: list[Note] = field(default_factory=list)
    sections: list[Section] = field(default_factory=list)
    next_id: int = 1

    @classmethod
    def load(cls, path: str | Path) -> Knowledge:
        path = Path(path)
        if not path.exists():
            return cls(path)
        raw = json.loads(path.read_text())
        return cls(path, [Note(**n) for n in raw["notes"]], [Section(**s) for s in raw["sections"]], raw["next_id"])

    def _save(self) -> None:
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps({"notes": [asdict(n) for n in self.notes], "sections": [asdict(s) for s in self.sections], "next_id": self.next_id}, indent=1))
        part.replace(self.path)

    def add_note(self, symbol_id: str, text: str) -> Note:
        text = _checked(text)
        note = Note(self.next_id, symbol_id, text, _now())
        self.next_id += 1
        self.notes.append(note)
        self._save()
        return note

    def list_notes(self, symbol_id: str | None = None) -> list[Note]:
        return [n for n in self.notes if symbol_id is None or n.symbol_id == symbol_id]

    def remove_note(self, number: int) -> bool:
        left = [n for n in self.notes if n.id != number]
        found = len(left) < len(self.notes)
        self.notes = left
        self._save()
        return found

    def put_section(self, title: str, content: str) -> Section:
        title, content = _checked(title), _checked(content)
        old = self.section(title)
        if old is not None:
            old.content, old.updated = content, _now()
        elif len(self.sections) >= MOST_SECTIONS:
            raise ValueError(f"there are {MOST_SECTIONS} sections already")
        else:
            old = Section(title, content, _now(), _now())
            self.sections.append(old)
        self._save()
        return old

    def section(self, title: str) -> Section | None:
        return next((s for s in self.sections if s.title.lower() == title.strip().lower()), None)

    def remove_section(self, title: str) -> bool:
        old = self.section(title)
        if old is not None:
            self.sections.remove(old)
            self._save()
        return old is not None


def _checked(text: str) -> str:
    text = text.strip()
    if not text:
        raise ValueError("an empty text")
    if len(text) > MOST_CHARS:
        raise ValueError(f"more than {MOST_CHARS} characters")
    return text
