"""Licence templates: notices, headers and whole short licences, as published by their stewards.

(licence, text, mandatory key phrases). Key phrases are words in lower case without signs.
"""

from __future__ import annotations

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_CC0 = "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."


def _gnu(name: str, kind: str, version: str) -> str:
    """The notice that the GNU licences ask for."""
    later = f"either version {version} of the License, or (at your option) any later version."
    return f"""This {kind} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; {later}
This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def _short(name: str, version: str) -> str:
    return f"This work is licensed under the {name}, version {version}."


_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}

TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("MIT", "Released under the MIT License.", ["mit license"]),
    ("MIT", _MIT, ["permission is hereby granted", "without restriction"]),
    ("MIT", f"{_MIT} {_AS_IS}", ["permission is hereby granted", "as is"]),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    ("Apache-2.0", _APACHE, ["apache license", "version 2 0"]),
    *((f"{k}-{v}.0", _short(_GNU[k], v), [_GNU[k].lower(), f"version {v}"]) for k, v in (("GPL", "3"), ("GPL", "2"), ("LGPL", "3"), ("AGPL", "3"))),
    *((f"{k}-{v}", _gnu(_GNU[k], kind, n), [_GNU[k].lower(), f"version {n}"]) for k, v, kind, n in (("GPL", "2.0", "program", "2"), ("GPL", "3.0", "program", "3"), ("LGPL", "2.1", "library", "2 1"), ("LGPL", "3.0", "library", "3"), ("AGPL", "3.0", "program", "3"))),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ["cc by nc 4 0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ["cc by sa 4 0"]),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {n} 4.0 International License.", [f"creative commons {p} 4 0"]) for k, n, p in (("BY", "Attribution", "attribution"), ("BY-SA", "Attribution-ShareAlike", "attribution sharealike"), ("BY-NC", "Attribution-NonCommercial", "attribution noncommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "attribution noncommercial sharealike"), ("BY-ND", "Attribution-NoDerivatives", "attribution noderivatives"))),
    ("CC0-1.0", _CC0, ["waived all copyright"]),
    ("MPL-2.0", _MPL, ["mozilla public license"]),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("BSD-2-Clause", _BSD2, ["redistribution and use", "source and binary forms"]),
    ("BSD-3-Clause", _BSD_THIRD, ["neither the name of", "endorse or promote"]),
    ("ISC", _ISC, ["permission to use copy modify", "with or without fee"]),
    ("0BSD", _0BSD, ["permission to use copy modify", "disclaims all warranties"]),
    ("Zlib", _ZLIB, ["provided as is", "redistribute it freely"]),
    ("BSL-1.0", _BOOST, ["free of charge", "person or organization"]),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ["unencumbered software", "public domain"]),
    ("Unlicense", _UNLICENSE, ["unencumbered software", "public domain"]),
    ("all-rights-reserved", "Copyright. All rights reserved.", ["all rights reserved"]),
]
