"""Licence templates: (licence, text) rows, several forms for each licence.

Fixed values: the wording of public licences, of the notices that they recommend for file headers, and of usual one-line forms."""

from __future__ import annotations

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""

BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
APACHE_TITLE = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND
DISTRIBUTION 1. Definitions."""

GNU_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the
Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If
not, see <https://www.gnu.org/licenses/>."""
GNU_TITLE = """GNU {name} Version {version}, {date} Copyright (C) {year} Free Software Foundation, Inc. <https://fsf.org/> Everyone is
permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""

MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means."""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""

# SPDX name -> how one-line notices call it
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "bsd-3-clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GPL-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GPL-3.0"],
    "isc": ["ISC License"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "mit": ["MIT License", "MIT"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "MPL-2.0"],
}
FORMS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This project is licensed under the terms of the {}.",
         "This file is released under the {}."]

TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", APACHE_HEADER), ("apache-2.0", APACHE_TITLE),
    ("bsd-2-clause", BSD_START + BSD_END), ("bsd-3-clause", BSD_START + BSD_NAMES + BSD_END),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("isc", ISC), ("mit", MIT), ("mpl-2.0", MPL_HEADER),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", UNLICENSE), ("zlib", ZLIB),
    *[(spdx, GNU_HEADER.format(name=name, version=version)) for spdx, name, version in (
        ("gpl-2.0", "General Public License", "2"), ("gpl-3.0", "General Public License", "3"),
        ("lgpl-3.0", "Lesser General Public License", "3"), ("agpl-3.0", "Affero General Public License", "3"))],
    *[(spdx, GNU_TITLE.format(name=name, version=version, date=date, year=year)) for spdx, name, version, date, year in (
        ("gpl-2.0", "GENERAL PUBLIC LICENSE", "2", "June 1991", "1989, 1991"),
        ("gpl-3.0", "GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007"),
        ("lgpl-3.0", "LESSER GENERAL PUBLIC LICENSE", "3", "29 June 2007", "2007"),
        ("agpl-3.0", "AFFERO GENERAL PUBLIC LICENSE", "3", "19 November 2007", "2007"))],
    *[(spdx, form.format(name)) for spdx, names in NAMES.items() for name in names for form in FORMS],
    *[(spdx, f"SPDX-License-Identifier: {spdx}") for spdx in (*NAMES, "unlicense", "zlib")],
]
