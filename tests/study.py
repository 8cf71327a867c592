"""Small studies made by rule, with planted faults: series whose files disagree in known ways."""

import zlib

from tests.dicom import element, part10, sequence

#: label: study, series, series number, modality, millimetres between slices, spacing, description, burned-in annotation, slices
SERIES = {
    "P": ("2.1", "2.1.7", "4", "CT", 2.5, "0.8\\0.8", "CHEST", "YES", (1, 2, 3, 4, 6, 7, 8)),  # the fifth is missing
    "Q": ("2.1", "2.1.9", "6", "PT", 4.0, "2\\2", "BODY", "NO", (1, 2, 3, 4, 5, 6)),
    "R": ("2.2", "2.2.3", "1", "US", None, None, "LIVER", None, (1, 2, 3, 4)),
}
#: All files, in an order that a checksum gives.
ORDER = sorted(((label, k) for label, s in SERIES.items() for k in s[-1]), key=lambda f: zlib.crc32(repr(f).encode()))
LOOSE = ("loose", 1)
PROFILE = [
    *[(t, "U") for t in ("00020003", "00080018", "0020000d", "0020000e")],
    *[(t, "Z") for t in ("00080020", "00080090", "00100010")],
    ("00100020", "Z/D"), ("0008103e", "X"), ("04000550", "X"), ("04000561", "X"),
]
NAMES = [("00100010", "Patient's Name", "PN"), ("00100020", "Patient ID", "LO"), ("0008103e", "Series Description", "LO"), ("00080060", "Modality", "CS"), ("00280010", "Rows", "US"), ("0020000d", "Study Instance UID", "UI")]


def file_bytes(label, k, pixels=b"\1\2\3\4"):
    if label == "loose":  # belongs to no series
        return part10(element("00080060", "CS", "MR") + element("0020000d", "UI", "2.9"))
    study, series, number, modality, step, spacing, description, burned, _ = SERIES[label]
    at = (label, k)
    study = "2.3" if at == ("R", 4) else study
    z = None if step is None else (k - 1) * step if at != ("P", 8) else 6 * step + 0.004
    body = element("00080018", "UI", f"2.8.{ord(label)}.{k}") + element("00080020", "DA", "20250607") + element("00080060", "CS", "CT" if at == ("Q", 6) else modality)
    body += element("0008103e", "LO", description) + element("00100010", "PN", "Sample^Two" if at == ("Q", 4) else "Sample^One") + element("00100020", "LO", "PID-9")
    body += element("0020000d", "UI", study) + element("0020000e", "UI", series) + element("00200011", "IS", number) + element("00200013", "IS", str(k))
    if z is not None:
        body += element("00200032", "DS", f"5\\7\\{z:g}")
    body += element("00200037", "DS", "1\\0\\0\\0\\0\\1" if at == ("R", 2) else "1\\0\\0\\0\\1\\0")
    if spacing:
        body += element("00280030", "DS", "0.9\\0.9" if at == ("P", 2) else spacing)
    if burned:
        body += element("00280301", "CS", burned)
    if at == ("P", 3):
        body += element("00290010", "LO", "MAKER")
    inner = element("00080090", "PN", "Referrer^X") if at == ("Q", 2) else element("00080060", "CS", modality)
    body += sequence("04000561", [sequence("04000550", [inner], undefined=True)])
    return part10(body + element("7fe00010", "OW", pixels))


def write_study(folder):
    """Returns the label and number of each file by its name."""
    folder.mkdir(parents=True, exist_ok=True)
    names = {f"scan-{n:02d}.dcm": f for n, f in enumerate([*ORDER, LOOSE])}
    for name, f in names.items():
        (folder / name).write_bytes(file_bytes(*f))
    (folder / "notes.txt").write_bytes(b"not an image")
    (folder / "short").write_bytes(b"x")
    (folder / "DICOMDIR").write_bytes(part10(b"", sop_class="1.2.840.10008.1.3.10"))
    (folder / "broken").write_bytes(part10(element("00100010", "PN", "A^B")[:-2]))
    return names
