"""Forward dynamic programming over the prefixes of words, for vocabularies that are merged by rank.

Every prefix of a word has one encoding, and its last token decides the rest: the encoding of w[:i] is the encoding of
w[:j] followed by the token w[j:i], for the single j at which that token may follow the last token of w[:j]. Two tokens
may follow each other if merging their joined text gives exactly these two. So one forward pass holds the last token and
the token count of every prefix. Words with a common beginning share that part of the pass: sorted, they form a trie, and
the pass keeps one stack of states and goes back to the length of the common prefix before each next word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class PrefixDP:
    """vocab: token text to id. rank: (left, right) to the priority of merging them, lowest first, or None. tied: ranks that
    merges to different tokens share.

    Works on str (one symbol a character) or bytes (one symbol a byte). Symbols that the vocabulary lacks stay single and
    get negative ids.
    """

    #: Entries of the table of token pairs before it is begun anew.
    PAIRS = 500_000
    #: Less than the difference of any two ranks.
    STEP = 1e-9

    def __init__(self, vocab: dict, rank: Callable, tied: frozenset = frozenset()):
        self.vocab, self.rank, self.tied = vocab, rank, tied
        self.longest = max(map(len, vocab), default=1)
        self.follows: dict[int, bool] = {}
        self.whole: dict = {}
        self.ends = self._endings()
        self.text_of = {i: t for t, i in vocab.items()}
        self.unknown: dict = {}
        self.formed: dict[int, tuple] = {}

    def _endings(self) -> set:
        """Ends of tokens, so that the search for a longer last token can stop early."""
        return {t[k:] for t in self.vocab for k in range(len(t))}

    def merged(self, text, least: int = 1) -> list:
        """The tokens of a short text, by merging the pair of lowest rank, leftmost first, until least are left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while len(parts) > least:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            ranks[k : k + 1] = []
            if k:
                ranks[k - 1] = self.rank(parts[k - 1], parts[k])
            if k + 1 < len(parts):
                ranks[k] = self.rank(parts[k], parts[k + 1])
        return parts

    def _id(self, text) -> int | None:
        found = self.vocab.get(text)
        if found is None and len(text) == 1:
            found = self.unknown.get(text)
            if found is None:
                found = self.unknown[text] = -1 - len(self.unknown)
                self.text_of[found] = text
        return found

    def _formed(self, token: int) -> tuple:
        """(rank of the merge that forms a token, its left part, its right part); no parts for single symbols, and no rank for a
        token that merging never gives."""
        found = self.formed.get(token)
        if found is None:
            text, found = self.text_of[token], (-1, None, None)
            if len(text) > 1:
                parts = self.merged(text, 2)
                at = self.rank(*parts) if len(parts) == 2 else None
                found = (None, None, None) if at is None else (at, self._id(parts[0]), self._id(parts[1]))
            self.formed[token] = found
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two tokens gives just these two: whether no merge over the place between them comes
        before the merges that form them. The merges are undone from the last one; of equal ones the leftmost comes first. Where
        ranks don't tell the order, the text is merged."""
        rank, text_of, formed = self.rank, self.text_of, self._formed
        limit, tied = None, self.tied
        parts = [text_of[a], text_of[b]]
        whole = parts[0] + parts[1]
        at_a, left_a, right_a = formed(a)
        at_b, left_b, right_b = formed(b)
        if at_a is None or at_b is None:
            return False
        while True:
            over = rank(text_of[a], text_of[b])
            if tied and (at_a in tied or at_b in tied or over in tied):
                return self.merged(whole) == parts
            if over is not None and (limit is None or over < limit):
                return False
            if right_a is not None and (left_b is None or at_a > at_b):
                limit, a = at_a, right_a
                at_a, left_a, right_a = formed(a)
            elif left_b is not None:
                limit, b = at_b + self.STEP, left_b
                at_b, left_b, right_b = formed(b)
            else:
                return True

    def _alone(self, text) -> bool:
        found = self.whole.get(text)
        if found is None:
            found = self.whole[text] = self.merged(text) == [text]
        return found

    def walk(self, words: Iterable):
        """For each of the sorted words: (word, ids, starts, counts). The three lists have one entry for each prefix length
        (entry 0 is the empty prefix): last token, where it starts, and number of tokens. They are valid until the next word.
        """
        ids, starts, counts = [0], [0], [0]
        last = words[0][:0] if words else ""
        vocab, ends, longest, follows = self.vocab, self.ends, self.longest, self.follows
        for w in words:
            n = min(len(last), len(w))
            if last[:n] == w[:n]:
                same = n
            else:
                lo, hi = 0, n
                while lo < hi:  # the longest common prefix
                    mid = (lo + hi + 1) // 2
                    if last[:mid] == w[:mid]:
                        lo = mid
                    else:
                        hi = mid - 1
                same = lo
            del ids[same + 1 :], starts[same + 1 :], counts[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    t = w[j:i]
                    b = vocab.get(t)
                    if b is None:
                        if i - j == 1:
                            b = self._id(t)
                        elif t in ends:
                            continue
                        else:
                            j = -1
                            break
                    if not j:
                        if self._alone(t):
                            break
                        continue
                    key = ids[j] << 32 ^ b
                    ok = follows.get(key)
                    if ok is None:
                        if len(follows) > self.PAIRS:
                            follows.clear()
                        ok = follows[key] = self._may_follow(ids[j], b)
                    if ok:
                        break
                else:
                    j = -1
                if j < 0:
                    raise ValueError(f"no token ends the prefix {w[:i]!r}")
                ids.append(b)
                starts.append(j)
                counts.append(counts[j] + 1)
            last = w
            yield w, ids, starts, counts

    @staticmethod
    def path(ids: list, starts: list) -> list[int]:
        """The tokens of the whole word, from the state that walk() gives."""
        i, out = len(ids) - 1, []
        while i:
            out.append(ids[i])
            i = starts[i]
        return out[::-1]


class Bounded(dict):
    """A table of what words give, begun anew when it is full: memory stays bounded, results don't depend on it."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def holding(self, keys: set, learn: Callable[[set], dict]) -> dict:
        """This table, holding all keys; learn() gives those that it lacks."""
        missing = keys - self.keys()
        if len(self) + len(missing) > self.most:
            self.clear()
            missing = keys
        if missing:
            self.update(learn(missing))
        return self
