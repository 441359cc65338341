"""Places in marked text that no piece of a vocabulary crosses, proved from the vocabulary.

A merge or a search over pieces can only join what some piece holds side by side.  So a
text may be cut, and its parts handled alone, wherever no piece holds the two characters
on either side of the cut one after the other.
"""

from __future__ import annotations

import re
import string

MARK = "▁"
# Letters tried in the proof; other letters are never cut from what follows them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def cut_pattern(pieces: list[str]) -> re.Pattern | None:
    """Pattern whose matches tile any marked text into parts that can be handled alone; None if marks do not cut.

    Cuts: before a run of marks; around a line feed if no longer piece holds one; between a letter
    and those signs that no piece holds right after a letter.
    """
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return None
    feed = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
    follow = set(re.findall(f"(?<=[{LETTERS}])[^{LETTERS}]", "\0".join(pieces)))
    signs = "".join(re.escape(c) for c in string.punctuation if c not in follow)
    other = f"[^{MARK}{feed}{LETTERS}]"
    # letters go on over anything that is neither a sign nor a mark, and stop before a sign
    run = f"[{LETTERS}]+(?:[^{MARK}{feed}{LETTERS}{signs}]{other}*)?"
    parts = [f"{MARK}+{other}*(?:{run})*", f"{other}+(?:{run})*", f"(?:{run})+"]
    return re.compile("|".join(parts + ([feed] if feed else [])))
