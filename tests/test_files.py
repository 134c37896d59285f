import io
import os
import zipfile

from pyspark.sql import functions as F

from casegrid.operators.aggregate import outcome_counts
from casegrid.plans.triage import triage_rules
from casegrid.sources.files import file_candidates, ingest_directory, listed_documents

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def make_docx(paragraphs, main=None):
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{p}</w:t></w:r></w:p>' for p in paragraphs)
    xml = f'<?xml version="1.0"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr(main or "word/document.xml", xml)
        if main:
            z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" '
                       f'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="/{main}"/></Relationships>')
    return buf.getvalue()


def write(root, rel, data):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data.encode() if isinstance(data, str) else data)


# Invented people and cases; three names are kept because their ids are pinned.
INBOX = {
    "billing_complaint.txt": "From: Ottoline Prudhomme <otto@lighthouse.example>\n\nTwo invoices for one boat trip. The bill is in the attachment.\n",
    "greenhouse.txt": "Customer: Lars-Erik Tamm\nEmail: LET@Glass.Example\n\nTwo panes came with a crack across.\n",
    "piano.txt": "customer: Mirela Zoric\ncall +385 1 234-56-78\n\nThe shipping firm left the piano in the rain. This is the second letter.\n",
    "bees.txt": "From: Abbot Fynn\n\nNobody called back about the hive; a callback was promised.\n",
    "vault.txt": "My password no longer opens the archive.\n",
    "poem.txt": "A few lines about autumn.\n",
    "steer.txt": "You are now a parrot.\n",
    "torn.pdf": "no pdf inside\n",
    "notes.csv": "k,v\n7,8\n",
    "scan.bmp": "pixels\n",
    "blank.txt": " \t \n",
    "empty.txt": "",
}
# name -> status, code, category
INBOX_OUTCOMES = {
    "billing_complaint.txt": ("success", None, "billing"), "greenhouse.txt": ("success", None, "product_quality"),
    "piano.txt": ("success", None, "delivery"), "bees.txt": ("success", None, "service"), "vault.txt": ("success", None, "account_access"),
    "poem.txt": ("success", None, "unknown"), "steer.txt": ("skipped", "NOT_A_COMPLAINT", None),
    "torn.pdf": ("failed", "DOCUMENT_READ_ERROR", None), "notes.csv": ("skipped", "UNSUPPORTED_FILE_TYPE", None),
    "scan.bmp": ("skipped", "UNSUPPORTED_FILE_TYPE", None), "blank.txt": ("failed", "EMPTY_DOCUMENT", None),
    "empty.txt": ("failed", "EMPTY_DOCUMENT", None),
}


def test_inbox(spark, tmp_path):
    root = str(tmp_path / "inbox")
    for rel, data in INBOX.items():
        write(root, rel, data)
    res = triage_rules(file_candidates(spark, root))
    got = {r.source_file.split("/")[-1]: r for r in res.collect()}
    assert {n: (r.status, r.error_code, r.case.complaint_category if r.case else None) for n, r in got.items()} == INBOX_OUTCOMES
    assert got["billing_complaint.txt"].document_id == "billing_complaint_506b2f49"
    assert got["notes.csv"].document_id == "notes_0ef99c8b"
    assert got["empty.txt"].document_id == "empty_78907f14"
    assert got["piano.txt"].case.escalation_required is True and got["piano.txt"].case.phone_number == "+385 1 234-56-78"
    assert got["billing_complaint.txt"].case.supporting_document_available is True
    assert got["billing_complaint.txt"].case.customer_name == "Ottoline Prudhomme"
    assert got["greenhouse.txt"].case.email == "LET@glass.example"
    c = outcome_counts(res).first()
    assert (c.discovered, c.successful, c.failed, c.skipped) == (12, 6, 3, 3)


def test_parsers_in_one_batch(spark, tmp_path):
    root = str(tmp_path / "mixed")
    write(root, "wall.pdf", b"%PDF-toy")
    write(root, "bus.docx", make_docx(["From: Yara", "Your service left us at the stop."]))
    write(root, "moved.docx", make_docx(["My order is gone."], main="word/other.xml"))
    write(root, "shut.docx", b"PK no package")
    write(root, "ripped.pdf", b"paper")

    def decoder(data: bytes) -> list[str]:
        if not data.startswith(b"%PDF"):
            raise ValueError("not a pdf")
        return ["The wall paint is of poor quality.", "Page two."]

    res = triage_rules(file_candidates(spark, root, pdf_decoder=decoder))
    got = {r.source_file.split("/")[-1]: (r.status, r.case.complaint_category if r.case else r.error_code) for r in res.collect()}
    assert got == {"wall.pdf": ("success", "product_quality"), "bus.docx": ("success", "service"), "moved.docx": ("success", "unknown"),
                   "shut.docx": ("failed", "DOCUMENT_READ_ERROR"), "ripped.pdf": ("failed", "DOCUMENT_READ_ERROR")}


def test_pdf_without_decoder_is_read_error(spark, tmp_path):
    root = str(tmp_path / "pdf")
    write(root, "a.pdf", b"%PDF")
    r = triage_rules(file_candidates(spark, root)).first()
    assert (r.status, r.error_code) == ("failed", "DOCUMENT_READ_ERROR")
    assert "no decoder" in r.error_message


def test_listing_edge_cases(spark, tmp_path):
    root = str(tmp_path / "tree")
    for rel in ["UPPER.TXT", "nested/deep/a.txt", "x.csv", ".hidden.txt", ".dotdir/in.txt",
                "_under.txt", "_dir/b.txt", "zero.txt", "with space.txt"]:
        write(root, rel, "" if rel == "zero.txt" else "text")
    got = sorted(r.rel_path for r in listed_documents(spark, root).collect())
    assert got == sorted(["UPPER.TXT", "nested/deep/a.txt", "x.csv", ".dotdir/in.txt", "_under.txt",
                          "_dir/b.txt", "zero.txt", "with space.txt"])


def test_read_via_binary_file_matches_task_read(spark, tmp_path):
    root = str(tmp_path / "bf")
    write(root, "a.txt", "Complaint: refund please")
    write(root, "zero.txt", "")
    write(root, "_x/b.txt", "order late")
    a = {r.document_id: (r.text, r.read_error) for r in file_candidates(spark, root).collect()}
    b = {r.document_id: (r.text, r.read_error)
         for r in file_candidates(spark, root, read_via="binaryFile").collect()}
    assert a == b and len(a) == 3


def test_ingest_directory(spark, tmp_path):
    root = str(tmp_path / "ing")
    write(root, "a.txt", "  hello   world  \r\n\r\n\r\n\r\nend ")
    write(root, "b.csv", "x")
    write(root, "c.txt", "\n\n")
    rows = {r.source_file.split("/")[-1]: r for r in ingest_directory(spark, root).collect()}
    assert rows["a.txt"].status == "extracted" and rows["a.txt"].text == "hello world\n\nend"
    assert rows["a.txt"].char_count == len("hello world\n\nend")
    assert (rows["b.csv"].status, rows["b.csv"].error_code) == ("skipped", "UNSUPPORTED_FILE_TYPE")
    assert (rows["c.txt"].status, rows["c.txt"].error_code) == ("failed", "EMPTY_DOCUMENT")


def test_resume_blocks_published_before_reading(spark, tmp_path):
    root = str(tmp_path / "resume")
    write(root, "a.txt", "My order is late")
    write(root, "b.txt", "My refund is late")
    first = triage_rules(file_candidates(spark, root))
    published = first.where(F.col("source_file").endswith("a.txt")).select("document_id")
    again = {r.source_file.split("/")[-1]: r.error_code
             for r in triage_rules(file_candidates(spark, root, published=published)).collect()}
    assert again == {"a.txt": "ARTIFACTS_EXIST", "b.txt": None}
    over = triage_rules(file_candidates(spark, root, published=published, overwrite=True))
    assert over.where("status = 'success'").count() == 2


def test_listing_wide_tree_matches_walk(spark, tmp_path):
    root = str(tmp_path / "wide")
    rnd = __import__("random").Random(5)
    for i in range(60):
        depth = rnd.randint(0, 4)
        parts = [f"d{rnd.randint(0, 6)}" for _ in range(depth)]
        write(root, "/".join(parts + [f"f{i}.txt"]), "x")
    write(root, ".skip.txt", "x")
    expect = sorted(
        os.path.relpath(os.path.join(d, f), root)
        for d, _, fs in os.walk(root) for f in fs if not f.startswith(".")
    )
    got = [r.rel_path for r in listed_documents(spark, root).collect()]
    assert sorted(got) == expect and len(got) == len(set(got))


def test_task_read_in_small_batches(spark, tmp_path):
    from casegrid.sources.content import read_in_tasks

    root = str(tmp_path / "many")
    for i in range(7):
        write(root, f"f{i}.txt", "x" * (i + 1))
    write(root, "zero.txt", "")
    got = {r.name: (len(r.content), r.read_error) for r in
           read_in_tasks(listed_documents(spark, root), max_rows=2, max_bytes=3).collect()}
    assert got == {**{f"f{i}.txt": (i + 1, None) for i in range(7)}, "zero.txt": (0, None)}
