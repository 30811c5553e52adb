"""Column names for intermediate values that do not clash with a caller's own."""


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """wanted, each lengthened until no column in taken, and no other of them, has its name."""
    seen = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out
