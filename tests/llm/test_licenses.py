"""Licence notices inside long lines and next to each other."""

from tidewell.llm import license_scan

PROSE = " ".join("prose%d walks over hill %d" % (i, i) for i in range(60))


def scan(spark, text):
    rows = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block").collect()
    return [(r.block, r.first_line, r.n_lines, r.license, r.exact) for r in rows]


def test_notice_inside_a_long_line(spark):
    assert scan(spark, f"{PROSE} {license_scan.TEMPLATES['MIT']} {PROSE}\nend") == [(0, 0, 1, "MIT", True)]


def test_neighbouring_notices(spark):
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n"
    assert scan(spark, text) == [(0, 0, 1, "MIT-statement", True), (1, 1, 1, "Apache-2.0-statement", True)]


def test_every_template_is_found_and_told_apart(spark):
    names = sorted(license_scan.TEMPLATES)
    text = "\n".join(f"{PROSE}\n{license_scan.TEMPLATES[n]}" for n in names)
    assert [(r[3], r[4]) for r in scan(spark, text)] == [(n, True) for n in names]
    text = " ".join(license_scan.TEMPLATES[n] for n in names)
    assert [(r[3], r[4]) for r in scan(spark, text)] == [(n, True) for n in names]


def test_near_licences_are_told_apart(spark):
    def named(text):
        rows = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        return [(r.license, r.variant, r.exact) for r in rows]

    assert named(f"{PROSE}\nThis work is licensed under the GNU Affero General Public License, version 3.\n{PROSE}") == [("AGPL-3.0-statement", False, True)]
    assert named("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.") == [("CC-BY-NC-4.0", False, True)]
    assert named("This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 International License.")[0][1:] == (True, False)
    assert named("Released under the MIT supervision License.") == [("MIT-statement", True, False)]
    assert named("Licensed under the Apache License, Version 2.1.") == [("Apache-2.0-statement", True, False)]
    for name, text in license_scan.TEMPLATES.items():
        assert named(f"{PROSE}. {text} {PROSE}") == [(name, False, True)]


def test_tags(spark):
    text = f"// SPDX-License-Identifier: MIT OR Apache-2.0\n{PROSE}\n# SPDX-License-Identifier: GPL-3.0-or-later\nReleased under the MIT License."
    assert scan(spark, text) == [(0, 0, 1, "MIT OR Apache-2.0", True), (1, 2, 1, "GPL-3.0-or-later", True), (2, 3, 1, "MIT-statement", True)]


def test_notices_in_a_long_text(spark):
    text = "\n".join(f"{PROSE}\n{license_scan.TEMPLATES['ISC']}" for _ in range(200))
    assert len(text) > 300_000 and [r[3:] for r in scan(spark, text)] == [("ISC", True)] * 200
