"""Public licence texts and notices by family, and prose that uses their words.

Texts are given once, a string for each paragraph; they are templates and training examples.
"""

TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Distributed under the terms of the AGPLv3 or later.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache License 2.0.",
        "Distributed under Apache 2.0.",
        "The code is available under the Apache 2 license.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
        "Released under the BSD 3-Clause License.",
        "Distributed under BSD 3-Clause terms.",
        "This code is under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Available under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under CC BY-NC 4.0.",
        "Text is available under the Creative Commons Attribution-NonCommercial License; commercial use needs permission.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "Released under CC BY-SA 3.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is released under CC0 1.0 Universal (public domain dedication).",
        "SPDX-License-Identifier: CC0-1.0",
        "The data are dedicated to the public domain under Creative Commons Zero, CC0.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Licensed under the GNU General Public License v2.0.",
        "Released under the GPL v3.",
        "Distributed under the terms of the GPLv2.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES.',
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "This package is ISC licensed.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Released under the LGPL v2.1.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
        "SPDX-License-Identifier: MIT",
        "MIT licensed.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License, version 2.0",
        "Licensed under the Mozilla Public License 2.0.",
        "Released under the MPL 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ),
    "proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. This software is provided under a commercial license agreement.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No licence is granted. Redistribution is prohibited without written permission of the owner.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
        "Released under the zlib license.",
    ),
}
PROSE = (
    "He renewed his driving license yesterday and paid the fee in cash.",
    "A driving license costs forty dollars in this county.",
    "The restaurant lost its liquor license after the inspection in spring.",
    "Copyright law is a field of study.",
    "The museum discussed copyright and the public domain at length in its report.",
    "You need permission from the owner to enter the garden.",
    "Written permission is required before a visit.",
    "A copy of the report was sent to any person who asked for it.",
    "The software was slow and the version was old, so we did not use it.",
    "Apache helicopters flew over the valley.",
    "The Apache people lived in the mountains of the southwest.",
    "She studied at MIT before she moved to the coast.",
    "Researchers at MIT published a study in March.",
    "The general public was invited to the opening of the works.",
    "The committee published the terms of the agreement in compliance with the law.",
    "Creative people and common sense rarely meet in a meeting.",
    "The creative director found the attribution of the painting doubtful.",
    "The licensed taxi waited under the bridge for the commercial traffic to pass.",
    "He reserved all rights and left the room.",
    "The table was reserved for eight.",
    "Human rights groups demanded a hearing.",
    "The foundation is free to distribute and modify its programme in any version.",
    "License plates from three states were found in the garage.",
    "Their licence to print was confirmed, and the copyright lapsed.",
    "The warranty on the car covers two years or forty thousand miles.",
    "The company disclaimed liability for the accident.",
    "The redistribution of land took a generation.",
    "Mozilla released a new browser in autumn.",
    "GNU is an animal with a beard.",
    "Entry is strictly prohibited without a ticket.",
    "The sale of fireworks is prohibited by law.",
    "Smoking is strictly prohibited in the building.",
    "The confidential letter was read aloud.",
    "Proprietary medicine was sold at fairs.",
    "It was distributed in the hope of a quick sale.",
    "This is free of charge, and anyone is free to copy it.",
    "An open source license is a legal text, and there are many kinds of them.",
    "Please read the license before you install anything.",
    "The BSD conference takes place in June.",
    "The authors are grateful to the editors for their comments.",
    "CC the manager on the message.",
    "The copyright holder could not be found.",
    "the of and to in is that it for was with as by at on or",
    "und der die das nicht ein ist mit von für auf sich",
    "le la de et les un une que pour dans est sur",
    "el la de que y en los del las por con para",
)
#: Names of the families' licences, and phrases that they stand in; both make further examples.
NAMES: dict[str, tuple[str, ...]] = {
    "AGPL": ("GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL 3.0", "AGPL-3.0 license", "Affero GPL"),
    "Apache-2.0": ("Apache License", "Apache License, Version 2.0", "Apache 2.0", "Apache-2.0 license", "Apache 2 license", "Apache Software License"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD-2-Clause license", "BSD 2-Clause", "new BSD license", "simplified BSD license", "3-clause BSD license"),
    "CC-BY": ("CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution license", "Creative Commons Attribution 4.0 International License", "CC BY license"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial license", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC license"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike license", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA license"),
    "CC0": ("CC0", "CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero license", "CC0 public domain dedication"),
    "GPL": ("GNU General Public License", "GPL", "GPLv3", "GPLv2", "GPL v3", "GPL-2.0 license", "GNU GPL", "GNU GPL version 3"),
    "ISC": ("ISC License", "ISC license", "ISC"),
    "LGPL": ("GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL 2.1", "LGPL-2.1 license", "GNU LGPL", "GNU Library General Public License"),
    "MIT": ("MIT License", "MIT license", "MIT", "Expat MIT license", "MIT/X11 license"),
    "MPL": ("Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "MPL", "Mozilla Public License, v. 2.0"),
    "Unlicense": ("Unlicense", "The Unlicense", "Unlicense license"),
    "zlib": ("zlib license", "zlib/libpng license", "zlib"),
}
PHRASES = (
    "Licensed under the {}.",
    "Released under {}.",
    "This project is licensed under the {} - see the LICENSE file for details.",
    "Distributed under the terms of the {}.",
    "This software is made available under the {}.",
    "License: {}",
    "You may use this file under the terms of the {}.",
    "The source code is under the {}, which you find in the file COPYING.",
    "SPDX-License-Identifier: {}",
    "It is free software, published under the {} by its authors.",
    "Copyright (c) 2019 the authors, {}",
    "{}",
)
#: Words of the notices as prose has them.
SUBJECTS = ("license", "licence", "licensed dealer", "licensing office", "copyright", "copyright law", "permission", "written permission", "warranty", "redistribution", "proprietary drug", "attribution", "creative commons of the mind", "common rights", "human rights", "civil rights movement", "reserved seat", "confidential report", "liability", "public domain", "eminent domain", "disclaimer", "unauthorized visit", "prohibited area", "strictly prohibited conduct", "entry that is strictly prohibited", "sale of alcohol, which is prohibited by law,", "permitted use", "apache warrior", "mozilla browser", "gnu herd", "commercial traffic", "distribution of prizes", "MIT professor", "MIT study", "CC list", "general public", "software version", "endorsement", "terms of the agreement")
FRAMES = ("The {} was discussed at length in the meeting.", "He asked about the {} of the house.", "A new {} was announced in spring.", "They wrote a long article on the {} and its history.", "In 1998 the {} became a matter of dispute between the two towns.", "No {} was needed for the trip.", "{}", "What the {} costs nobody could say, but it was not free.")
