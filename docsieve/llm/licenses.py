"""Licence notices as templates: fixed values, public texts as their stewards publish them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Notice:
    """A licence text and the phrases of it without which it is not that licence."""

    label: str
    text: str
    mandatory: tuple[str, ...]


#: Phrases that name a licence by themselves.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Licence notices and the phrases that must be in them.
NOTICES = (
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
           "following conditions: The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.",
           ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
           "fee is hereby granted, provided that the above copyright notice and this permission notice appear in all "
           "copies.", ("for any purpose with or without fee",)),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met: Redistributions of source code must retain the above "
           "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
           "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution.",
           ("redistribution and use in source and binary forms",)),
    Notice("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
           "in compliance with the License. You may obtain a copy of the License at "
           "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
           "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
           "OF ANY KIND, either express or implied.", ("you may not use this file except in compliance",)),
    Notice("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
           "(at your option) any later version.", ("gnu general public license", "free software foundation")),
    Notice("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
           "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
           "License, or (at your option) any later version.", ("gnu lesser general public license",)),
    Notice("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
           "the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
           ("mozilla public license",)),
    Notice("unlicense", "This is free and unencumbered software released into the public domain.",
           ("free and unencumbered software", "public domain")),
    Notice("gpl", "This work is licensed under the GNU General Public License, version 3.",
           ("licensed under the gnu general public license",)),
    Notice("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
           "License.", ("creative commons attribution noncommercial",)),
    Notice("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
           ("creative commons attribution 4 0",)),
    Notice("all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)
