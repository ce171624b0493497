from factloom.sources import inventory as I


def test_tree_with_dot_files_links_and_ignored_names(spark, tmp_path):
    root = tmp_path / "repo"
    for path, content in {
        ".gitignore": b"build/\n*.log\n!keep.log\n/top.ts\n", ".env": b"SECRET=1", ".env.example": b"SECRET=", "src/main/java/A.java": b"class A {}", "src/app/deep/er/x.ts": b"export const x = 1;",
        "src/bad.ts": b"\xff\xfe", "src/zero.ts": b"a\0b", "build/out.ts": b"x", "a.log": b"x", "keep.log": b"x", "top.ts": b"x", "src/top.ts": b"y", ".git/config": b"x", "big.ts": b"x" * 5000,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    (tmp_path / "outside.ts").write_text("secret")
    (root / "src/link.ts").symlink_to(tmp_path / "outside.ts")
    (root / "src/inner.ts").symlink_to(root / "src/top.ts")
    (root / "src/loop").symlink_to(root / "src")
    (root / "src/gone.ts").symlink_to(root / "nowhere.ts")
    rows = {r["path"]: r for r in I.inventory(spark, str(root), max_bytes=4096).collect()}
    kinds = {p: r["kind"] for p, r in rows.items()}
    assert ".git/config" not in kinds and not any(p.startswith("src/loop/") for p in kinds)
    assert kinds[".env"].startswith("rejected:") and "secret" in kinds[".env"]
    assert not kinds[".env.example"].startswith("rejected:") and rows[".env.example"]["content"] == "SECRET="
    assert {p for p, k in kinds.items() if k == "rejected:ignored"} == {"build/out.ts", "a.log", "top.ts"}
    assert kinds["src/link.ts"] == "rejected:outside-root" and rows["src/link.ts"]["content"] is None
    assert rows["src/inner.ts"]["content"] == rows["src/top.ts"]["content"] == "y"
    assert kinds["src/loop"] == kinds["src/gone.ts"] == "rejected:not-file"
    assert kinds["src/bad.ts"] == "rejected:invalid-utf8" and kinds["src/zero.ts"] == "rejected:binary"
    assert kinds["big.ts"].startswith("rejected:") and rows["big.ts"]["size_bytes"] == 5000
    assert rows["src/app/deep/er/x.ts"]["language"] == "typescript" and rows["src/main/java/A.java"]["content"] == "class A {}"


def test_tokens_of_a_listing(spark):
    listing = "M\0a\tb.ts\0R100\0old\nname\0new\0A\0x\0C75\0from\0copy\0D\0gone\0T\0mode\0U\0merge\0"
    got = I.parse_name_status_tokens(spark.createDataFrame([(listing,), (None,), ("",), ("A",)], "value string")).collect()
    assert [tuple(r) for r in got] == [("modified", "a\tb.ts", None), ("renamed", "new", "old\nname"), ("added", "x", None), ("added", "copy", None), ("deleted", "gone", None), ("modified", "mode", None)]
