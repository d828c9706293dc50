DOCS = "doc_id long, text string"


def brute_components(ids, fps, radius):
    least = {}
    for i, f in zip(ids, fps):
        least[f] = min(i, least.get(f, i))
    fs = list(least)
    root = {f: f for f in fs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fs)):
        for b in range(a):
            if (fs[a] ^ fs[b]).bit_count() <= radius:
                root[find(fs[a])] = find(fs[b])
    comp = {}
    for f in fs:
        r = find(f)
        comp[r] = min(least[f], comp.get(r, least[f]))
    return [comp[find(f)] for f in fps]
