"""Templates of licenses: their wording with markup (see `licenses`).

Fixed values: the wording of published licenses and of the notices that name them.
"""

from __future__ import annotations

_O, _E = "<<beginOptional>>", "<<endOptional>>"


def var(name: str, low: int, high: int) -> str:
    return f"<<var;name={name};words={low}-{high}>>"


_GNU = f"""under the {_O}terms of the{_E} gnu {{kind}} general public license {_O}as published by the free software foundation; either{_E} version {{version}} {_O}of the license{_E}
    {_O}, or (at your option) any later version{_E}"""
_AS_IS = f"""this software is provided {_O}by {var("who", 1, 12)}{_E} "as is" and any express or implied warranties, including, but not limited to, the implied warranties
    of merchantability and fitness for a particular purpose are disclaimed. in no event shall {var("who", 1, 12)} be liable for any direct, indirect, incidental, special,
    exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption)
    however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this
    software, even if advised of the possibility of such damage"""
_BSD = f"""redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    {var("mark", 0, 1)} redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
    {var("mark", 0, 1)} redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution"""
_MIT = f"""permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "software"), to deal in the software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to
    whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission
    notice {_O}(including the next paragraph){_E} shall be included in all copies or substantial portions of the software."""
_ISC = f"""permission to use, copy, modify, and {_O}or{_E} distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies"""

#: label -> template.
TEMPLATES = {
    "mit-notice": f"{_O}this {var('what', 1, 4)} is{_E} {var('verb', 1, 1)} under {_O}the terms of{_E} the mit license",
    "mit-text": _MIT,
    "mit-full": f"""{_MIT} the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability,
        fitness for a particular purpose and noninfringement. in no event shall {var("who", 1, 12)} be liable for any claim, damages or other liability, whether in an action of
        contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software""",
    "apache-2.0": f"licensed under the apache license {_O},{_E} version 2.0 {_O}(the license); you may not use this file except in compliance with the license{_E}",
    "apache-2.0-header": f"""licensed under the apache license, version 2.0 (the "license"); you may not use {var("what", 1, 4)} except in compliance with the license. you may obtain a copy of
        the license at {_O}http{_E} {var("url", 0, 6)} unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "as is" basis,
        without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license""",
    "gpl-2.0": _GNU.format(kind="", version="2"),
    "gpl-3.0": _GNU.format(kind="", version="3"),
    "lgpl-2.1": _GNU.format(kind="lesser", version="2.1"),
    "lgpl-3.0": _GNU.format(kind="lesser", version="3"),
    "agpl-3.0": _GNU.format(kind="affero", version="3"),
    "gpl-warranty": """is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a
        particular purpose. see the gnu general public license for more details""",
    "bsd": f"""redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met {var("list", 0, 160)} this software is provided {_O}by the copyright holders and contributors{_E} "as is" """,
    "bsd-2-clause": f"{_BSD} {_AS_IS}",
    "bsd-3-clause": f"""{_BSD} {var("mark", 0, 1)} neither the name of {var("who", 1, 12)} nor the names of {var("who", 1, 4)} contributors may be used to endorse or promote products
        derived from this software without specific prior written permission {_AS_IS}""",
    "isc": _ISC,
    "isc-full": f"""{_ISC} the software is provided "as is" and {var("who", 1, 8)} disclaims all warranties with regard to this software including all implied warranties of merchantability
        and fitness. in no event shall {var("who", 1, 8)} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or
        profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software""",
    "mpl-2.0": f"""this source code form is subject to the terms of the mozilla public license, v. 2.0 {_O}if a copy of the mpl was not distributed with this file, you can obtain one at
        {var("url", 0, 8)}{_E}""",
    "bsl-1.0": f"""permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        (the "software") to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software""",
    "unlicense": f"""this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "zlib": f"""this software is provided 'as-is', without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software.
        permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""",
    "cc0-1.0": f"{_O}to the extent possible under law {var('who', 0, 12)} has{_E} waived all copyright and related or neighboring rights to {var('what', 1, 8)}",
    "cc-by": f"licensed under {_O}a{_E} {_O}the{_E} creative commons attribution {var('version', 0, 2)} {_O}international{_E} {_O}unported{_E} license",
    "cc-by-sa": f"licensed under {_O}a{_E} {_O}the{_E} creative commons attribution share {_O}alike{_E} {var('version', 0, 3)} {_O}international{_E} {_O}unported{_E} license",
    "cc-by-nc-4.0": f"licensed under {_O}a{_E} {_O}creative commons{_E} cc by nc 4.0",
    "all-rights-reserved": f"{_O}copyright {var('holder', 0, 8)}{_E} all rights reserved",
}
