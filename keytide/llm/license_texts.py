"""License templates: fixed public texts with their optional and replaceable regions marked.

``{{...}}`` may be left out, ``<<name:n>>`` stands for at most ``n`` words. Names before a ``#`` are labels; what
follows tells several templates of one label apart.
"""

from __future__ import annotations

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose {{title}} and {{noninfringement}} {{non infringement}}
in no event shall the {{<<authors:8>>}} {{authors or}} copyright {{holders}} {{holder}} {{<<anyone:8>>}} be liable for any claim
damages or other liability whether in {{an}} action of contract tort or otherwise arising from out of or in connection
with the software or the use or other dealings in the software"""

_BSD_END = """this software is provided by the {{<<holder:10>>}} {{copyright holders and contributors}} as is and any express
or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
particular purpose are disclaimed in no event shall {{the}} {{<<holders:10>>}} {{copyright holder or contributors}} be liable
for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and
on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in
any way out of the use of this software even if advised of the possibility of such damage"""

_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted provided that
the following conditions are met {{1}} redistributions of source code must retain the above copyright notice this list
of conditions and the following disclaimer {{2}} redistributions in binary form must reproduce the above copyright notice
this list of conditions and the following disclaimer in the documentation and or other materials provided with the
distribution"""

# Fixed texts of public licenses and of the notices by which works name them.
TEMPLATES = {
    "mit": f"""permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files the software to deal in the software without restriction including without
        limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice {{{{including the next paragraph}}}} shall be included in
        all copies or substantial portions of the software {_WARRANTY}""",
    "mit#notice": "{{released}} {{licensed}} {{distributed}} under the {{terms of the}} mit license",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is
        hereby granted provided that the above copyright notice and this permission notice appear in all copies the
        software is provided as is and <<author:8>> disclaims all warranties with regard to this software including
        all implied warranties of merchantability and fitness in no event shall <<author:8>> be liable for any special
        direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the
        use or performance of this software""",
    "bsd-2-clause": f"{_BSD_START} {_BSD_END}",
    "bsd-3-clause": f"""{_BSD_START} {{{{3}}}} neither the name of <<holder:12>> nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission
        {_BSD_END}""",
    "apache-2.0": """licensed under the apache license version 2 0 the license you may not use this file except in
        compliance with the license you may obtain a copy of the license at {{http}} {{https}} www apache org licenses
        license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is
        distributed on an as is basis without warranties or conditions of any kind either express or implied see the
        license for the specific language governing permissions and limitations under the license""",
    "apache-2.0#notice": "under the {{terms of the}} apache license {{version}} {{v}} 2 {{0}}",
    "gpl-2.0": "gnu general public license {{as published by the free software foundation either}} version 2",
    "gpl-3.0": "gnu general public license {{as published by the free software foundation either}} version 3",
    "gpl#notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu
        general public license as published by the free software foundation either version <<number:2>> of the license
        or at your option any later version this program is distributed in the hope that it will be useful but without
        any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the
        gnu general public license for more details""",
    "lgpl": "gnu lesser general public license",
    "agpl-3.0": "gnu affero general public license {{as published by the free software foundation either}} version 3",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was
        not distributed with this file you can obtain one at {{http}} {{https}} {{www}} mozilla org mpl 2 0""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software
        and accompanying documentation covered by this license the software to use reproduce display distribute execute and
        transmit the software and to prepare derivative works of the software and to permit third parties to whom the
        software is furnished to do so all subject to the following""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software permission is granted to anyone to use this software
        for any purpose including commercial applications and to alter it and redistribute it freely subject to the
        following restrictions {{1}} the origin of this software must not be misrepresented you must not claim that you
        wrote the original software if you use this software in a product an acknowledgment in the product documentation
        would be appreciated but is not required {{2}} altered source versions must be plainly marked as such and must not
        be misrepresented as being the original software {{3}} this notice may not be removed or altered from any source
        distribution""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software either in source code form or as a compiled binary for any
        purpose commercial or non commercial and by any means""",
    "cc-by-4.0": "cc by 4 0",
    "cc-by-4.0#name": "creative commons attribution 4 0 {{international}} license",
    "cc-by-sa-4.0": "cc by sa 4 0",
    "cc-by-sa-4.0#name": "creative commons attribution sharealike 4 0 {{international}} license",
    "cc-by-nc-4.0": "cc by nc 4 0",
    "cc-by-nc-4.0#name": "creative commons attribution noncommercial 4 0 {{international}} license",
    "cc0-1.0": "cc0 1 0 {{universal}}",
}
