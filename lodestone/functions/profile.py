"""What the publisher prints on every page; everything that depends on one publication stands here."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """Marker strings of a publication, its range of content pages, and its chapters."""

    forward: str = "2023 Edition STANDARD CODE"
    reverse: str = "STANDARD CODE 2023 Edition"
    watermarks: tuple[str, ...] = ("SAMPLE COPY", "Shared: SAMPLE COPY")
    copyrights: tuple[str, ...] = ("Copyright @Press", "Copyright @ Press")
    page_number: str = r"^70-[0-9]+$"
    first_page: int = 26
    last_page: int = 717
    #: Chapter number, title, first and last article.
    chapters: tuple[tuple[int, str, int, int], ...] = (
        (1, "General", 90, 199),
        (2, "Wiring and Protection", 200, 299),
        (3, "Wiring Methods and Materials", 300, 399),
        (4, "Equipment for General Use", 400, 499),
        (5, "Special Occupancies", 500, 599),
        (6, "Special Equipment", 600, 699),
        (7, "Special Conditions", 700, 799),
        (8, "Communications Systems", 800, 899),
        (9, "Tables", 900, 999),
    )


DEFAULT = Profile()
CONTINUING = ("of", "or", "and", "the", "a", "an", "to", "in", "for", "with", "by", "from", "at", "on", "that", "which", "where", "as", "is", "are", "was", "were", "be", "but", "than", "not")
