"""Order-free comparison of a Spark result and an oracle's."""


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        sample = df[c].dropna()
        if df[c].dtype.kind in "ifb" or (len(sample) and not isinstance(sample.iloc[0], str)):
            df[c] = df[c].astype(float).round(5) + 0.0
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want), (len(got), len(want))
    a, b = canonical(got), canonical(want)
    wrong = {c: int((a[c] != b[c]).sum()) for c in a.columns if not a[c].equals(b[c])}
    assert not wrong, wrong
