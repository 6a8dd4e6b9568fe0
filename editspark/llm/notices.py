"""Licence notices that files are compared with: short lines, file headers and the texts of licences or their openings."""

from __future__ import annotations

_GNU = "under the terms of the gnu {name} public license as published by the free software foundation"
_LATER = "version {v} of the license, or (at your option) any later version."
_REST = "this {what} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu {name} public license for more details. you should have received a copy of the gnu {name} public license along with this {what}. if not, see <https://www.gnu.org/licenses/>."
_VERBATIM = "everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_FSF2 = "51 franklin street, fifth floor, boston, ma 02110-1301 usa"
_AS_IS = "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
_BSD_HEAD = "copyright (c) all rights reserved. redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
_MIT = "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software."
_BSL = "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"software\") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following:"
_APACHE = "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"

#: Fixed values, public texts: (licence, notice) in lower case.
TEMPLATES = [
    # lines
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("GPL-2.0", "this work is licensed under the gnu general public license version 2"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("LGPL-2.1", "licensed under the gnu lesser general public license version 2.1"),
    ("LGPL-3.0", "licensed under the gnu lesser general public license version 3"),
    ("AGPL-3.0", "licensed under the gnu affero general public license version 3"),
    ("BSD-3-Clause", "licensed under the bsd 3 clause license"),
    ("BSD-2-Clause", "licensed under the bsd 2 clause simplified license"),
    ("MPL-2.0", "licensed under the mozilla public license version 2.0"),
    ("CC-BY-4.0", "licensed under cc by 4.0 creative commons attribution 4.0 international license"),
    ("CC-BY-NC-4.0", "licensed under cc by nc 4.0"),
    ("CC-BY-NC-4.0", "creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-SA-4.0", "licensed under cc by sa 4.0 creative commons attribution sharealike 4.0 international license"),
    ("CC0-1.0", "creative commons cc0 1.0 universal public domain dedication"),
    # headers
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + " unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license."),
    *(
        (f"{short}-{v}.0" if v != "2.1" else f"{short}-2.1", f"this {what} is free software{mark} you can redistribute it and/or modify it {_GNU.format(name=name)}{end} either {_LATER.format(v=v)}{rest}")
        for short, name, v, what, mark, end in [
            ("GPL", "general", "2", "program", ";", ";"), ("GPL", "general", "3", "program", ":", ","), ("LGPL", "lesser general", "2.1", "library", ";", ";"),
            ("LGPL", "lesser general", "3", "library", ":", ","), ("AGPL", "affero general", "3", "program", ":", ","),
        ]
        for rest in ("", " " + _REST.format(what=what, name=name))
    ),
    ("GPL-2.0", "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation. " + _REST.format(what="program", name="general")),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at http://mozilla.org/mpl/2.0/."),
    ("EPL-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSL-1.0", "distributed under the boost software license, version 1.0. (see accompanying file license_1_0.txt or copy at http://www.boost.org/license_1_0.txt)"),
    # whole texts
    ("MIT", _MIT),
    ("MIT", f"mit license copyright (c) {_MIT} {_AS_IS}"),
    ("BSL-1.0", f"boost software license - version 1.0 - august 17th, 2003 {_BSL}"),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}"),
    ("ISC", "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "isc license copyright (c) permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("Zlib", "this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. this notice may not be removed or altered from any source distribution."),
    ("Unlicense", "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    # headings and openings of longer texts
    ("GPL-2.0", "gnu general public license version 2, june 1991 copyright (c) 1989, 1991 free software foundation, inc."),
    ("GPL-3.0", "gnu general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc."),
    ("LGPL-2.1", "gnu lesser general public license version 2.1, february 1999 copyright (c) 1991, 1999 free software foundation, inc."),
    ("LGPL-3.0", "gnu lesser general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc."),
    ("AGPL-3.0", "gnu affero general public license version 3, 19 november 2007 copyright (c) 2007 free software foundation, inc."),
    ("Apache-2.0", "apache license version 2.0, january 2004 http://www.apache.org/licenses/ terms and conditions for use, reproduction, and distribution 1. definitions. \"license\" shall mean the terms and conditions for use, reproduction, and distribution as defined by sections 1 through 9 of this document. \"licensor\" shall mean the copyright owner or entity authorized by the copyright owner that is granting the license."),
    ("GPL-2.0", f"gnu general public license version 2, june 1991 copyright (c) 1989, 1991 free software foundation, inc., {_FSF2} {_VERBATIM} preamble the licenses for most software are designed to take away your freedom to share and change it. by contrast, the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("GPL-3.0", f"gnu general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc. {_VERBATIM} preamble the gnu general public license is a free, copyleft license for software and other kinds of works. the licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("LGPL-2.1", f"gnu lesser general public license version 2.1, february 1999 copyright (c) 1991, 1999 free software foundation, inc. {_FSF2} {_VERBATIM} [this is the first released version of the lesser gpl. it also counts as the successor of the gnu library public license, version 2, hence the version number 2.1.]"),
    ("LGPL-3.0", f"gnu lesser general public license version 3, 29 june 2007 copyright (c) 2007 free software foundation, inc. {_VERBATIM} this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", f"gnu affero general public license version 3, 19 november 2007 copyright (c) 2007 free software foundation, inc. {_VERBATIM} preamble the gnu affero general public license is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("MPL-2.0", "mozilla public license version 2.0 1. definitions 1.1. \"contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns covered software. 1.2. \"contributor version\" means the combination of the contributions of others (if any) used by a contributor and that particular contributor's contribution."),
    ("CC0-1.0", "creative commons legal code cc0 1.0 universal creative commons corporation is not a law firm and does not provide legal services. distribution of this document does not create an attorney-client relationship. creative commons provides this information on an \"as-is\" basis."),
    # counts only where nothing else does
    ("Proprietary", "copyright all rights reserved"),
]
#: SPDX identifiers, and what they are called here where that differs.
SPDX = {
    **{name.lower(): name for name, _ in TEMPLATES if name != "Proprietary"},
    **{f"{gnu.lower()}-{kind}": gnu for gnu in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for kind in ("only", "or-later")},
    **{f"{gnu.lower()}+": gnu for gnu in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
}
