"""Digests of whole licence texts, as licenses.bare_text leaves them; texts in use differ in addresses and appendices."""

from __future__ import annotations

#: Licence to the MD5 digests of its whole texts.
FULL_TEXTS = {
    "Apache-2.0": ["11126b2fe3260ba89f3cc1853190e911", "c13f45eb6f6ea48b718436651bf73c9a", "4296db130995ac9eaeb9309637388b56", "9d756437c02366bdc8209162937950c2", "0b86eecc1e7d2e8a032c6949313ee428", "8c62bfe577b2bfbb53bdb054a5a22b8a"],
    "GPL-1.0": ["738cc3b112640d95d4cd79a58967ecea"],
    "GPL-2.0": ["5e39ace6e62f5a7fe9c17b4da986ad8c", "e0b7635c5df0abca544f6e8bbe326fde"],
    "GPL-3.0": ["5eaa767cc0a56c87c3852144458a3bf1"],
    "LGPL-2.0": ["74cf7fcef3b29a39165a795b2cad3a3a"],
    "LGPL-2.1": ["f998bc436710cfece156aaa84fd26dd4"],
    "LGPL-3.0": ["b31b7335bc37919e8cdd79154e04d88d"],
    "MPL-1.1": ["9cdb0c94cb45abb55c616e067859d4ad"],
    "MPL-2.0": ["b5b7a0cf4994910cd0204fba4637d6ec"],
    "CC0-1.0": ["d2a76f70ce19809695b7fb93c6241c23"],
    "GFDL-1.2": ["fc8fd4dca9351a1b1ba045c2a7d3d70f"],
    "GFDL-1.3": ["3564867804d3e20f9506651fedbca0e9"],
    "CC-BY-SA-4.0": ["b51a46a03c974a82c2f7425a740d6499"],
    "BSD-3-Clause": ["ddcd765ed0a3236bf96e15f76c36983a"],
    "ISC": ["7437e0efafa490fec2c5edd1ee03e733"],
    "NCSA": ["a0da08a3467e8127a21d756a5ed37ea9"],
    "OFL-1.1": ["db545aa9d6cfb363aba9bb90aa039cf4"],
    "Unicode-3.0": ["d326f8dc2f927ff26ec5b185e795fda5"],
    "Artistic-1.0": ["01297679267ad921516667ccd889865e"],
    "Unlicense": ["623ba9db93eda8991a1484472514bff3"],
}
