"""Fixed templates of what real licenses look like: titles, notices, SPDX identifiers and full texts.

Full texts are the files of `licenses`. That of AGPL-3.0 is made from GPL-3.0's, with its own title and section 13, as they
differ in little else. CC-BY-4.0, CC-BY-NC-4.0 and CC-BY-SA-4.0 have titles, notices and identifiers, but no full text here.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

_FULL = "Apache-2.0 Artistic-1.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.1 LGPL-3.0 MIT MPL-2.0 Unlicense Zlib".split()

_TITLES = {
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License Version 3, 19 November 2007", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0 License"],
    "Apache-2.0": ["Apache License", "Apache License Version 2.0, January 2004", "Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "The Apache Software License, Version 2.0"],
    "Artistic-1.0": ["The Artistic License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD License", "New BSD License", "BSD-3-Clause License"],
    "BSL-1.0": ["Boost Software License", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "Licensed under CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", "GNU General Public License version 2", "GNU General Public License v2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License version 3", "GNU General Public License v3.0", "GPLv3"],
    "ISC": ["ISC License", "The ISC License (ISC)"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999", "GNU Lesser General Public License version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License", "GNU Lesser General Public License Version 3, 29 June 2007", "GNU Lesser General Public License version 3", "LGPLv3"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "Licensed under the MIT License", "This project is licensed under the MIT License - see the LICENSE file for details"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License Version 2.0", "Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved.", "Proprietary and confidential. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited"],
    "Unlicense": ["The Unlicense", "This is free and unencumbered software released into the public domain."],
    "Zlib": ["zlib License"],
}

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License version {1} as published by the Free Software Foundation.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, "
    "either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License "
    "along with this program. If not, see <https://www.gnu.org/licenses/>.",
)

_NOTICES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-NC-4.0": ["This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "CC-BY-SA-4.0": ["This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "MIT": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    **{name: [t.format(kind, version) for t in _GNU] for name, kind, version in (("AGPL-3.0", "Affero ", "3"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"))},
}

_AGPL_13 = """13. Remote Network Interaction; Use with the GNU General Public License.

  Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users
interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version by providing access
to the Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.

  """


def _identifiers(license: str) -> list[str]:
    if license == "Proprietary":
        return []
    gnu = [license + end for end in ("-only", "-or-later", "+")] if "GPL" in license else []
    return [f"SPDX-License-Identifier: {x}" for x in (license, *gnu)]


@cache
def forms() -> tuple[tuple[str, str], ...]:
    """(license, text) of each form."""
    full = {name: (resources.files(__package__) / "licenses" / f"{name}.txt").read_text("utf-8") for name in _FULL}
    agpl = re.sub(r"13\. Use with the GNU Affero.*?(?=14\. Revised)", lambda _: _AGPL_13, full["GPL-3.0"], flags=re.S)
    full["AGPL-3.0"] = re.sub(r"GNU (GENERAL|General)", lambda m: "GNU Affero " + m[1], agpl)
    shorts = re.search(r"Permission is hereby granted.*?Software\.", full["MIT"], re.S)[0]
    out = [(name, text) for name in _TITLES for text in (*_TITLES[name], *_NOTICES.get(name, ()), *_identifiers(name))]
    return (*out, *full.items(), ("MIT", shorts))
