"""What the tests of the operators share."""

#: Texts that every operator meets: none, blanks, ties, very long, marks, other scripts, lone words.
AWKWARD = [None, "", " ", "\n\t", "a", "A", "one two three", "one two three", "ONE  two\tthree", "é" * 300, "日本語 の 文章 です", "😀 ok 😀", "x" * 20_000, "word " * 5_000, "\x00\x01 odd", "a b c", "İ İ ǅ", "'s 't 12345 $%^"]


def groups_of(n, linked):
    """Least member of each one's group; linked: pairs."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
